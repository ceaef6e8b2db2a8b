"""The driver's tables as corpora, pages and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDES = {"en": "src", "fr": "trg"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side_of(lang: Column) -> Column:
    return F.when(lang == "en", F.lit("src")).when(lang == "fr", F.lit("trg"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals rows anew where a scan's fullest task holds more than twice a core's share of them, as with one small file or a
    file of few row groups, which a scan can't divide; only ``key`` is read to tell. Other inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.select(key).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return df.repartition(4 * cores) if held.all and held.most * cores > 2 * held.all else df


def texts(spark: SparkSession, sf_dir: str, days: int = 30) -> DataFrame:
    """texts(side, doc, day_idx, text) of the English (source) and French (target) documents."""
    docs = spread(read(spark, sf_dir, "documents").where(F.col("lang").isin(*SIDES)).select("doc_id", "lang", "text"), "lang")
    return docs.select(side_of(F.col("lang")).alias("side"), F.col("doc_id").alias("doc"), F.pmod("doc_id", F.lit(days)).cast("int").alias("day_idx"), "text")


def corpus(texts: DataFrame) -> DataFrame:
    """corpus(side, doc, day_idx, line_no, line) of texts."""
    return texts.select("side", "doc", "day_idx", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def page_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_version(url, segment_id, fetched, modified, lang, content, html): pages as a crawl of three segments."""
    pages = read(spark, sf_dir, "pages")
    return pages.select(
        "url",
        (F.col("page_id") % 3).alias("segment_id"),
        (F.col("page_id") * 1000).alias("fetched"),
        F.trim(F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", " "), r"\s+", " ")).alias("content"),
        "html",
    )


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series(stem, bin, v): events of a user by day."""
    events = read(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return events.groupBy(F.col("user_id").cast("string").alias("stem"), day.cast("int").alias("bin")).agg(F.count("*").cast("double").alias("v"))
