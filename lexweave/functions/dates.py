"""Dates in addresses and in page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by language, from January on.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "az": "yanvar fevral mart aprel may iyun iyul avqust sentyabr oktyabr noyabr dekabr",
    "sq": "janar shkurt mars prill maj qershor korrik gusht shtator tetor nëntor dhjetor",
    "bn": "জানুয়ারী ফেব্রুয়ারী মার্চ এপ্রিল মে জুন জুলাই আগস্ট সেপ্টেম্বর অক্টোবর নভেম্বর ডিসেম্বর",
    "cy": "ionawr chwefror mawrth ebrill mai mehefin gorffennaf awst medi hydref tachwedd rhagfyr",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "sk": "januára februára marca apríla mája júna júla augusta septembra októbra novembra decembra",
    "lv": "janvāris februāris marts aprīlis maijs jūnijs jūlijs augusts septembris oktobris novembris decembris",
    "so": "january february march april may june july august september october november december",
}
# Content patterns by site and language; the groups are what their letters say: d, m (number), M (name), y, t (hh:mm).
CONTENT = (
    ("dw", "de", r"Deutsche Welle \| (\d?\d).(\d?\d).(\d{4})", "dmy", "en"),
    ("bbc", "en", r"(\d\d:\d\d)\s[^\s\d]{3},\s[^\s\d]+,\s(\d?\d)\s([^\s\d]+)\s(\d\d\d\d)", "tdMy", "en"),
    ("bbc", "en", r"[^\s\d]+,\s(\d?\d)\s([^\s\d]+),\s(\d\d\d\d),\s(\d?\d:\d\d)\s[^\s\d]{3}", "dMyt", "en"),
    ("bbc", "en", r"[^\s\d]+,\s(\d?\d)\s([^\s\d]+)\s(\d\d\d\d),\s(\d?\d:\d\d)\s[^\s\d]{3}", "dMyt", "en"),
    ("bbc", "ru", r"[^\s\d]+,\s(\d?\d)\s([^\s\d]+)\s(\d\d\d\d)\sг.,\s(\d?\d:\d\d)\s[^\s\d]{3}", "dMyt", "ru"),
    ("bbc", "az", r"[\D]+(\d?\d)\s([^\s\d]+),\s(\d\d\d\d)\s-\sPublished\s(\d?\d:\d\d)\s[^\s\d]{3}", "dMyt", "az"),
    ("bbc", "sq", r"[\D]+,\s(\d?\d)\s([^\s\d]+)\s(\d\d\d\d)\s-\s(\d?\d:\d\d)\s[^\s\d]{3}", "dMyt", "sq"),
    ("bbc", "cy", r"[^\s\d]+,\s(\d?\d)\s([^\s\d]+),\s(\d\d\d\d),\s(\d?\d:\d\d)\s[^\s\d]{3}", "dMyt", "cy"),
    ("bbc", "es", r"[^\s\d]+,\s(\d?\d)\sde\s([^\s\d]+)\sde\s(\d{4})\s+-\s+(\d?\d:\d\d)\s[^\s\d]{3}", "dMyt", "es"),
    ("bbc", "bn", r"(\d?\d)\s([^\s\d]+)\s(\d\d\d\d)\s-\s(\d?\d:\d\d)", "dMyt", "bn"),
    ("bbc", "zh", r"(\d{4})年\s*(\d?\d)月\s*(\d?\d)日", "ymd", "en"),
    ("voa", "zh", r"(\d{4})年\s*(\d?\d)月\s*(\d?\d)日", "ymd", "en"),
    ("voa", "fa", r"(\d?\d).(\d?\d).(\d\d)", "dmY", "en"),
    ("voa", "so", r"\D(\d?\d)\s+([\D\S]+?)\s+(\d{4})", "dMy", "so"),
    ("atlas", "sk", r"(\d?\d)\.\s*([^\s\d]+)\s(\d{4})\D(\d?\d:\d\d)", "dMyt", "sk"),
    ("inform", "kk", r"(\d?\d)\.(\d?\d).(\d{4})\s/\s(\d?\d:\d\d)", "dmyt", "en"),
    ("diena", "lv", r",\s+(\d?\d)\.\s([^\s\d]+)\s\((\d{4})\) (\d?\d:\d\d)", "dMyt", "lv"),
    ("azatliq", "tt", r"(\d?\d)\.(\d?\d).(\d{4})", "dmy", "en"),
)


def _short(names: list[str]) -> dict[str, int]:
    """Months by full name, and by the first three letters where those tell one from the others."""
    heads = [n[:3] for n in names]
    return {h: i + 1 for i, h in enumerate(heads) if heads.count(h) == 1} | {n: i + 1 for i, n in enumerate(names)}


def month_number(name: Column, lang: str) -> Column:
    """Month by its name, or by the first three letters of it."""
    table = F.create_map(*(F.lit(x) for pair in _short(MONTHS[lang].split()).items() for x in pair))
    return F.try_element_at(table, F.lower(F.regexp_replace(name, r"[.,]", "")))


def pattern_date(text: Column, pattern: str, order: str, lang: str = "en") -> Column:
    """The moment that the first match of a pattern gives, in UTC; null without a match or for an impossible date."""
    part = {c: F.regexp_extract(text, pattern, i + 1) for i, c in enumerate(order)}
    year = F.lit(2000) + part["Y"].try_cast("int") if "Y" in part else part["y"].try_cast("int")
    month = month_number(part["M"], lang) if "M" in part else part["m"].try_cast("int")
    time = part.get("t", F.lit("0:0"))
    hour, minute = (F.regexp_extract(time, r"^(\d+):(\d+)$", k).try_cast("int") for k in (1, 2))
    return F.try_make_timestamp(year, month, part["d"].try_cast("int"), hour, minute, F.lit(0).cast("decimal(16,6)"))


def bbc_url_date(url: Column) -> Column:
    return F.to_timestamp(F.try_to_timestamp(F.regexp_extract(url, r"/(\d{6})_[^/]*$", 1), F.lit("yyMMdd")))


def voa_url_date(url: Column) -> Column:
    """The first of four patterns that the file name has; a later one isn't tried if its date is impossible."""
    name = F.regexp_extract(url, r"([^/]*)$", 1)
    forms = (
        (r"\d\d\d\d_\d?\d_\d?\d", r"(\d\d\d\d)_(\d?\d)_(\d?\d)", "ymd"),
        (r"\d\d\d\d-\d?\d-\d?\d", r"(\d\d\d\d)-(\d?\d)-(\d?\d)", "ymd"),
        (r"\d?\d-\d?\d-\d\d\d\d", r"(\d?\d)-(\d?\d)-(\d\d\d\d)", "mdy"),
        (r"\d\d\D\D\D\d\d", r"(\d\d)(\D\D\D)(\d\d)", "dMY"),
    )
    out = F.lit(None).cast("timestamp")
    for find, pattern, order in reversed(forms):
        out = F.when(name.rlike(find), pattern_date(name, pattern, order)).otherwise(out)
    return out


def lenta_url_date(url: Column) -> Column:
    return pattern_date(url, r"(\d\d\d\d)/(\d\d)/(\d\d)", "ymd")


def url_date(site: Column, url: Column) -> Column:
    return F.when(site == "bbc", bbc_url_date(url)).when(site == "voa", voa_url_date(url)).when(site == "lenta", lenta_url_date(url))


def _month_table() -> Column:
    """``language:name`` to month for every month name and unambiguous three letters."""
    entries: dict[str, int] = {}
    for lang, names in MONTHS.items():
        entries |= {f"{lang}:{k}": v for k, v in _short(names.split()).items()}
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def content_date(site: Column, lang: Column, content: Column) -> Column:
    """By the patterns of the page's site and language, in their order. Chinese of either script has one.

    The rules are data: a page looks up its few and one expression applies them, whatever their number.
    """
    rules: dict[str, list[Column]] = {}
    for s, code, pattern, order, months in CONTENT:
        place = {c: order.find(c) + 1 for c in "dmMyYt"}
        fields = [F.lit(pattern).alias("pattern"), F.lit(months).alias("months"), *(F.lit(place[c]).alias(n) for c, n in zip("dmMyYt", ("day", "month", "word", "year", "short", "time"), strict=True))]
        rules.setdefault(f"{s}:{code}", []).append(F.struct(*fields))
    plain = F.when(lang.startswith("zh"), F.lit("zh")).otherwise(lang)
    own = F.try_element_at(F.create_map(*(x for k, v in rules.items() for x in (F.lit(k), F.array(*v)))), F.concat_ws(":", site, plain))

    def parsed(r: Column) -> Column:
        def part(at: Column) -> Column:
            return F.when(at > 0, F.call_function("regexp_extract", content, r.pattern, at))

        name = F.lower(F.regexp_replace(part(r.word), r"[.,]", ""))
        month = F.coalesce(part(r.month).try_cast("int"), F.try_element_at(_month_table(), F.concat_ws(":", r.months, name)))
        year = F.coalesce(part(r.year).try_cast("int"), part(r.short).try_cast("int") + 2000)
        time = F.split(F.coalesce(part(r.time), F.lit("0:0")), ":")
        hour, minute = (F.get(time, F.lit(k)).try_cast("int") for k in (0, 1))
        return F.try_make_timestamp(year, month, part(r.day).try_cast("int"), hour, minute, F.lit(0).cast("decimal(16,6)"))

    return F.get(F.filter(F.transform(own, parsed), lambda x: x.isNotNull()), F.lit(0))
