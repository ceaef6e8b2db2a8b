"""Language codes, and which pages are in which language by their address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes that count as languages.
CODES = (
    "af sq am ar hy az eu be bn bs bh bg my ca chr zh zh-CN zh-TW hr cs da dv nl en eo et tl fi fr gl ka de el gn gu he hi hu is "
    "id iu ga it ja kn kk km ko ku ky la lo lv lt mk ms ml mt mr mn ne no or ps fa pl pt pa ro ru sa sr sd si sk sl so es sw sv tg "
    "ta tt ti te th bo tk tr uk ur uz ug vi cy yi"
).split()

# Site sections and their languages.
BBC_SECTIONS = {
    "azeri": "az", "albanian": "sq", "bengali": "bn", "persian": "fa", "hindi": "hi", "arabic": "ar", "indonesia": "id", "irish": "ga",
    "kyrgyz": "ky", "nepali": "ne", "russian": "ru", "pashto": "ps", "serbian": "sr", "somali": "so", "tamil": "ta", "turkce": "tr",
    "turkish": "tr", "ukrainian": "uk", "urdu": "ur", "uzbek": "uz", "cymru": "cy", "welsh": "cy", "mundo": "es", "spanish": "es",
    "chinese/simp": "zh-CN", "chinese/trad": "zh-TW", "ukchina/simp": "zh-CN", "ukchina/trad": "zh-TW", "zhongwen/simp": "zh-CN",
    "zhongwen/trad": "zh-TW", "english": "en",
}
BBC_ENGLISH = ("local", "[12]")
VOA_SECTIONS = {
    "armenian": "hy", "bosnian": "bs", "azerbaijani": "az", "indonesian": "id", "pashto": "ps", "persian": "fa", "russian": "ru",
    "somali": "so", "swahili": "sw", "thai": "th", "turkish": "tr", "ukrainian": "uk", "urdu": "ur", "uzbek": "uz", "chinese": "zh",
}
#: Other sites: what the address without protocol starts with, the site's name, and its language.
SITES = (
    (r"^(www\.)?dw-world\.de", "dw", "de"),
    (r"^(www\.)?lenta\.ru", "lenta", "ru"),
    (r"^([^/]*\.)?atlas\.sk", "atlas", "sk"),
    (r"^(www\.)?inform\.kz", "inform", "kk"),
    (r"^(www\.)?diena\.lv", "diena", "lv"),
    (r"^(www\.)?azatliq\.org", "azatliq", "tt"),
)


def known_code(code: Column) -> Column:
    """The code if it is one exactly, else null."""
    return F.when(code.isin(*CODES), code)


def html_language(html: Column) -> Column:
    """The lang attribute of the first html tag, trimmed and lower-cased, if it is a code."""
    tag = F.regexp_extract(html, r"(?i)<html[^>]*>", 0)
    found = F.lower(F.trim(F.regexp_extract(tag, r"(?i)\slang\s*=\s*\"*([^\s=\">]+)\"*", 1)))
    return known_code(found)


def after_first_dot(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, r"^[^.]*\.", ""))


def without_protocol(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, r"^.*?://", ""))


def _section(url: Column, pattern: str, sections: dict[str, str]) -> Column:
    found = F.regexp_extract(after_first_dot(url), pattern, 1)
    table = F.create_map(*(F.lit(x) for pair in sections.items() for x in pair))
    return F.when(found != "", F.element_at(table, found))


def site(url: Column) -> Column:
    """The news site that an address belongs to, null for all others."""
    out = F.when(bbc_language(url).isNotNull(), F.lit("bbc")).when(voa_language(url).isNotNull(), F.lit("voa"))
    for pattern, name, _ in SITES:
        out = out.when(without_protocol(url).rlike(pattern), F.lit(name))
    return out


def bbc_language(url: Column) -> Column:
    names = "|".join(BBC_SECTIONS)
    by_section = _section(url, rf"^bbc\.co\.uk/(?:hi/|low/)?({names})/", BBC_SECTIONS)
    english = "|".join(BBC_ENGLISH)
    return F.coalesce(by_section, F.when(after_first_dot(url).rlike(rf"^bbc\.co\.uk/(?:{english})/"), F.lit("en")))


def voa_language(url: Column) -> Column:
    return _section(url, rf"^voanews\.com/({'|'.join(VOA_SECTIONS)})/", VOA_SECTIONS)


def url_language(url: Column) -> Column:
    """Language by address: the first site of the chain that claims it."""
    out = F.coalesce(bbc_language(url), voa_language(url))
    rest = F.lit(None).cast("string")
    for pattern, _, code in reversed(SITES):
        rest = F.when(without_protocol(url).rlike(pattern), F.lit(code)).otherwise(rest)
    return F.coalesce(out, rest)


# What follows the first dot of the addresses of one site's English pages.
ENGLISH_PAGES = (r"^bbc.co.uk/(hi/|low/)?english/", r"^bbc.co.uk/local/", r"^bbc.co.uk/[12]/")


def bbc_english(url: Column) -> Column:
    """Whether what follows an address's first dot, in any case, is of that site's English pages."""
    rest = F.lower(F.substring(url, F.instr(url, ".") + 1, F.length(url)))
    return F.coalesce(rest.rlike("|".join(ENGLISH_PAGES)), F.lit(False))
