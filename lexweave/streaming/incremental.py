"""Pages and daily counts as they come in; the batch operators do the work."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages as P
from ..sources import files


def _newest(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, str]:
    """Each bucket's folder of the newest complete generation, of those below ``before``. Only names are listed."""
    done = {p.rsplit("/", 1)[0] for p in files.matching(spark, f"{folder}/generation=*/_SUCCESS")}
    found: dict[int, tuple[int, str]] = {}
    for path in files.matching(spark, f"{folder}/generation=*/bucket=*"):
        generation, bucket = map(int, re.search(r"/generation=(\d+)/bucket=(\d+)$", path).groups())
        if path.rsplit("/", 1)[0] in done and (before is None or generation < before):
            found[bucket] = max(found.get(bucket, (-1, "")), (generation, path))
    return {bucket: path for bucket, (_, path) in found.items()}


def merged_pages(spark: SparkSession, folder: str) -> DataFrame | None:
    """The pages that merge_pages() has put together so far; None before its first batch."""
    paths = _newest(spark, folder).values()
    return spark.read.parquet(*paths) if paths else None


def merge_pages(stream: DataFrame, folder: str, checkpoint: str, buckets: int = 64):
    """Merges page versions of each micro-batch with what the folder holds.

    Pages lie in buckets by address. A batch rewrites only the buckets that its pages fall into, as generation=n/bucket=k,
    from the newest older generation of each, so a batch that runs again gives the same. Older generations stay until tidy().
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
        batch = batch.persist()
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets``
        held = _newest(spark, folder, before=number)
        paths = [held[b] for b in touched if b in held]
        out = P.merge(spark.read.parquet(*paths), batch) if paths else P.merge(batch)
        if touched:
            out.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/generation={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def tidy(spark: SparkSession, folder: str) -> None:
    """Removes buckets that a newer generation replaces; to be called while no stream writes and nothing reads the folder."""
    kept = set(_newest(spark, folder).values())
    for path in files.matching(spark, f"{folder}/generation=*/bucket=*"):
        if path not in kept:
            system, where = files.store(spark, path)
            system.delete(where, True)


def daily_counts(words: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(day, stem, n) of a stream of (ts, stem); days are closed when ``lateness`` has passed."""
    counted = words.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "stem").agg(F.count("*").alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), "stem", "n")
