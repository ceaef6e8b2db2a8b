"""A crawl of news pages made from the driver's pages, for the page queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages as L
from ..operators import pages as P
from ..sources import tables


def _two(expr: str) -> str:
    return f"lpad(cast({expr} as string), 2, '0')"


def news_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page versions whose addresses and contents carry languages and dates as news sites write them."""
    month, day = "(page_id % 12 + 1)", "(page_id % 28 + 1)"
    pages = tables.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    address = F.expr(
        f"""case page_id % 8
        when 0 then concat('http://www.bbc.co.uk/russian/08', {_two(month)}, {_two(day)}, '_p', page_id, '.shtml')
        when 1 then concat('http://www1.voanews.com/persian/news/a-2010-', {month}, '-', {day}, '-', page_id, '.html')
        when 2 then concat('http://www.voanews.com/urdu/news/T-', {_two(day)}, 'Apr09-', page_id, '.html')
        when 3 then concat('http://lenta.ru/news/2010/', {_two(month)}, '/', {_two(day)}, '/r', page_id)
        when 4 then concat('http://www.dw-world.de/dw/article/', page_id)
        when 5 then concat('http://news.bbc.co.uk/hi/english/world/', page_id, '.stm')
        when 6 then concat('http://www.inform.kz/x', page_id)
        else url end"""
    )
    stamp = F.expr(
        f"""case page_id % 8
        when 4 then concat('Deutsche Welle | ', {day}, '.', {month}, '.2010 ')
        when 5 then concat('Saturday, ', {day}, ' January 2008, 19:10 GMT ')
        when 6 then concat({_two(day)}, '.', {_two(month)}, '.2010 / 13:58 ')
        else '' end"""
    )
    text = F.trim(F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", " "), r"\s+", " "))
    return pages.select(
        address.alias("url"), (F.col("page_id") % 3).alias("segment_id"), (F.col("page_id") * 1000).alias("fetched"), F.lit(None).cast("long").alias("modified"),
        F.when(F.col("page_id") % 8 == 7, L.html_language(F.col("html"))).alias("lang"), F.concat(stamp, text).alias("content"),
    )


def described() -> Column:
    """A page's metadata, a key with two values, and one without any."""
    size = F.length("html").cast("string")
    return F.create_map(F.lit("size"), F.array(size, F.concat(size, F.lit(" characters"))), F.lit("none"), F.array(F.lit(""))).alias("meta")


def meta_text(column: str = "meta") -> Column:
    """A map of lists as text, by key."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(column)), lambda e: F.concat(e.key, F.lit("="), F.array_join(e.value, ","))), ";")


def links_text() -> Column:
    return F.array_join(F.transform("links", lambda x: F.concat(x.target, F.lit(" "), x.anchor)), "\n")


def recrawled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two datasets: the pages, and a later crawl of the even ones, of which every fourth has new content."""
    first = tables.page_versions(spark, sf_dir).select("url", (F.col("fetched") / 1000).cast("long").alias("page"), "segment_id", "fetched", F.lit(None).cast("long").alias("modified"), L.html_language(F.col("html")).alias("lang"), "content", described(), P.links_of(F.col("html")).alias("links"))
    again = F.create_map(F.lit("crawl"), F.array(F.lit("second")), F.lit("again"), F.array(F.lit("yes"), F.lit("")))
    first = first.withColumn("meta", F.map_concat("meta", F.create_map(F.lit("crawl"), F.array(F.lit("first")))))
    later = first.where("fetched / 1000 % 2 = 0").withColumns({"content": F.when(F.col("fetched") / 1000 % 4 == 0, F.concat("content", F.lit(" new"))).otherwise(F.col("content")), "fetched": F.col("fetched") + 500, "lang": F.lit("xx"), "meta": again})
    return first, later


def crawl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, segment_id, record, kind, fetched, modified, html, title, content, meta, links): the pages as a crawl's four kinds of records."""
    base = tables.page_versions(spark, sf_dir)
    empty = {"fetched": "long", "modified": "long", "html": "string", "title": "string", "content": "string", "meta": "map<string,array<string>>", "links": P.LINKS}
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    kinds = {"fetch": {"fetched": F.col("fetched")}, "raw": {"html": F.col("html"), "meta": described()}, "parse": {"title": title, "links": P.links_of(F.col("html")), "meta": F.create_map(F.lit("size"), F.array(F.lit("0")), F.lit("title"), F.array(title))}, "text": {"content": F.col("content")}}
    out = None
    for kind, own in kinds.items():
        rows = base.select("url", "segment_id", F.col("fetched").alias("record"), F.lit(kind).alias("kind"), *((own[c] if c in own else F.lit(None)).cast(t).alias(c) for c, t in empty.items()))
        out = rows if out is None else out.unionByName(rows)
    return out


def prepare(versions: DataFrame) -> DataFrame:
    """Crawl preparation from complete versions on: single versions, language and date, dated corpus."""
    return P.dated_corpus(P.language_and_date(P.single_versions(P.complete(versions))))
