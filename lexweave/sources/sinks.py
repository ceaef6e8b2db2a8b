"""Writers: corpora by language and day, phrase and reordering tables, rankings, signatures, dictionaries, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def by_language(pages: DataFrame, path: str) -> None:
    """A folder a language; pages without one go to ``none``."""
    pages.withColumn("lang", F.coalesce("lang", F.lit("none"))).write.partitionBy("lang").parquet(path)


def pages_xml(pages: DataFrame, path: str) -> None:
    """<Page> elements by language, contents in base64; metadata (meta) and links, where there are such columns, by version."""
    nested = []
    if "meta" in pages.columns:
        nested.append(F.transform(F.sort_array(F.map_entries("meta")), lambda e: F.struct(e.key.alias("_key"), e.value.alias("Value"))).alias("Metadata"))
    if "links" in pages.columns:
        nested.append(F.transform("links", lambda x: F.struct(x.target.alias("_to"), x.anchor.alias("_anchor"))).alias("Link"))
    version = F.struct(F.col("segment_id").cast("string").alias("_segment"), F.col("fetched").alias("_fetched"), F.col("modified").alias("_modified"), F.base64(F.encode("content", "UTF-8")).alias("ParsedContent"), *nested)
    rows = pages.groupBy(F.col("url").alias("_URL"), F.col("lang").alias("_lang")).agg(F.sort_array(F.collect_list(version)).alias("PageVersion"))
    rows.withColumn("lang", F.coalesce("_lang", F.lit("none"))).write.partitionBy("lang").format("xml").option("rootTag", "Pages").option("rowTag", "Page").save(path)


def crawl_sequences(records: DataFrame, folder: str, segment: str, kind: str) -> None:
    """Records of one segment and kind as Hadoop sequence files of address and JSON; see readers.crawl_sequences."""
    fields = [c for c in ("record", "fetched", "modified", "html", "title", "content", "meta", "links") if c in records.columns]
    pairs = records.select("url", F.to_json(F.struct(*fields)).alias("record"))
    pairs.rdd.map(tuple).saveAsSequenceFile(f"{folder}/segments/{segment}/{kind}")


def dated_corpus(corpus: DataFrame, path: str) -> None:
    """Folders lang, year and day, to which later runs add; rejected rows, and those without a language of letters or
    without a day, go to a folder of their own."""
    good = F.coalesce(~F.col("rejected") & F.col("lang").rlike("^[a-zA-Z][a-zA-Z_-]*$") & F.col("day").isNotNull(), F.lit(False))
    corpus.where(good).select("lang", "year", "day", "text").write.mode("append").partitionBy("lang", "year", "day").text(f"{path}/days")
    corpus.where(~good).select(F.concat_ws("\t", "lang", "modified", "text").alias("text")).write.mode("append").text(f"{path}/rejected")


def lines(df: DataFrame, line, path: str, *order: str) -> None:
    """One text line a row, in the order given."""
    df.orderBy(*order).select(line.alias("line")).write.text(path)


def ranking(sets: DataFrame, path: str) -> None:
    """Each source, then its sets of tied candidates from the best on; sets: (src, score, line)."""
    body = sets.select("src", F.col("score"), F.concat(F.lit("   ["), F.col("score").cast("string"), F.lit("] "), F.col("line")).alias("line"), F.lit(1).alias("o"))
    head = sets.select("src", F.lit(None).cast("double").alias("score"), F.col("src").alias("line"), F.lit(0).alias("o")).distinct()
    head.unionByName(body).orderBy("src", "o", F.desc("score")).select("line").write.text(path)


def signatures(sigs: DataFrame, path: str) -> None:
    """(phrase, signature of 32 bytes) in order of phrase."""
    from ..operators.lsh import packed

    sigs.select(F.col("stem").alias("phrase"), packed(F.col("sig")).alias("signature")).orderBy("phrase").write.parquet(path)


def dictionary(entries: DataFrame, path: str) -> None:
    """Tab-separated; with a third column where there is one."""
    entries.write.option("sep", "\t").option("emptyValue", "").csv(path)


def cache(df: DataFrame, path: str) -> DataFrame:
    """Writes classes or properties once; later calls read what is there."""
    spark: SparkSession = df.sparkSession
    if not files.exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
