"""Contiguous shards of near equal bytes (operator 2), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

OVERHEAD = 16


def byte_size(text: str = "text", overhead: int = OVERHEAD):
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(overhead)


def range_parts(df: DataFrame, *order: str) -> DataFrame:
    """Rows dealt into ranges of the order columns; ``part`` numbers the ranges and ``tie`` tells equal rows apart.

    The scan position in ``tie`` keeps a group of equal rows from filling one range. The table is settled, so that
    everything read from it sees the same ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("tie", F.monotonically_increasing_id())
    return settle(tied.repartitionByRange(n, *order, "tie").withColumn("part", F.spark_partition_id()))


def prefix_sums(parts: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """Adds to each row the sum of every named expression over all rows before it.

    One pass totals each range, the totals of the ranges (one row each) are added up, and a window inside each range
    gives the rest.
    """
    totals = parts.groupBy("part").agg(*(F.sum(F.expr(e)).alias(k) for k, e in sums.items()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"base_{k}") for k in sums))
    inside = Window.partitionBy("part").orderBy(*order, "tie").rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumns({k: F.coalesce(F.sum(F.expr(e)).over(inside), F.lit(0)) for k, e in sums.items()})
    joined = summed.join(bases, "part")
    return joined.withColumns({k: F.col(k) + F.col(f"base_{k}") for k in sums}).drop(*(f"base_{k}" for k in sums))


def shard_by_bytes(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """Cuts the rows, in id order, into shards of near equal bytes.

    Every row goes to the shard in whose equal share of the bytes its middle lies, so that a shard's bytes are off by
    less than the largest row. Only ids, sizes and checksums are shuffled, never texts.

    Texts of any length are sized whole, on the JVM. Null ids come first; a null text has size 0 and the checksum of empty text; rows with equal ids are ordered by
    checksum, then size, then scan order; an empty table gives no rows; other columns are ignored.
    Returns: the id, size, text_crc32, shard, slot (place within its shard, from 0), start (bytes before it).
    """
    text = F.col(text_col)
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    slim = df.select(F.col(id_col), byte_size(text_col, overhead).alias("size"), crc.alias("text_crc32"))
    order = [id_col, "text_crc32", "size"]
    parts = range_parts(slim, *order)
    placed = prefix_sums(parts, order, start="size", index="1L")
    total = parts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    placed = placed.join(F.broadcast(total)).withColumn(
        "shard", F.least(F.lit(shards - 1), F.expr(f"(2 * start + size) * {shards}L div (2 * total)")).cast("int")
    )
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first_index"))  # a row a shard
    out = placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("index") - F.col("first_index"))
    return out.select(id_col, "size", "text_crc32", "shard", "slot", "start")
