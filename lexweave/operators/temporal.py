"""Time distributions: collection, alignment, re-binning, normalising, cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .counting import count_words, few_stems
from .edit import product


def collect_words(sents: DataFrame, stems: DataFrame) -> DataFrame:
    """(side, stem, bin, v): occurrences by day of the given classes; those of a side that has many are looked up among the counts."""
    counted = count_words(sents, "side", "day_idx", stems=few_stems(stems)).select("side", "stem", F.col("day_idx").alias("bin"), F.col("n").cast("double").alias("v"))
    return counted.join(stems.select("side", "stem"), ["side", "stem"], "left_semi")


def collect_phrases(found: DataFrame) -> DataFrame:
    """(side, phrase, bin, v): occurrences (side, phrase, day_idx) by day, or counts n of them."""
    if "n" in found.columns:
        return found.select("side", "phrase", F.col("day_idx").alias("bin"), F.col("n").cast("double").alias("v"))
    return found.groupBy("side", "phrase", F.col("day_idx").alias("bin")).agg(F.count("*").cast("double").alias("v"))


def days_with_text(corpus: DataFrame) -> DataFrame:
    return corpus.select("side", F.col("day_idx").alias("bin")).distinct()


def align(tdist: DataFrame, bins: DataFrame) -> DataFrame:
    """Keeps bins that both sides have; bins: (side, bin)."""
    both = bins.groupBy("bin").agg(F.countDistinct("side").alias("k")).where("k = 2").select("bin")
    return tdist.join(both, "bin", "left_semi")


def tumbling(tdist: DataFrame, size: int, keys: tuple[str, ...] = ("stem",)) -> DataFrame:
    """New bin j sums old bins jk to jk + k - 1; empty bins are left out."""
    _check(size)
    _unnormalised(tdist)
    return tdist.groupBy(*keys, F.floor(F.col("bin") / size).cast("int").alias("bin")).agg(F.sum("v").alias("v"))


def sliding(tdist: DataFrame, size: int, keys: tuple[str, ...] = ("stem",)) -> DataFrame:
    """New bin j sums old bins j to j + k - 1; the last window is the first that covers the last bin."""
    _check(size)
    _unnormalised(tdist)
    last = Window.partitionBy(*keys)
    reach = tdist.withColumn("last", F.max("bin").over(last))
    opened = reach.withColumn("j", F.explode(F.sequence(F.greatest(F.lit(0), F.col("bin") - size + 1), F.col("bin"))))
    return opened.where(F.col("j") <= F.greatest(F.lit(0), F.col("last") - size + 1)).groupBy(*keys, F.col("j").cast("int").alias("bin")).agg(F.sum("v").alias("v"))


def _check(size: int) -> None:
    if size <= 0:
        raise ValueError("a window has at least one bin")


#: Metadata of the values of a normalised series.
NORMALISED = {"normalised": True}


def _unnormalised(tdist: DataFrame) -> None:
    if tdist.schema["v"].metadata.get("normalised"):
        raise ValueError("a normalised series can't be put into other bins")


def normalize(tdist: DataFrame, keys: tuple[str, ...] = ("stem",)) -> DataFrame:
    """Adds each distribution up to 1; the column's metadata says so."""
    return tdist.withColumn("v", (F.col("v") / F.sum("v").over(Window.partitionBy(*keys))).alias("v", metadata=NORMALISED))


def merge(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("stem",)) -> DataFrame:
    return a.unionByName(b).groupBy(*keys, "bin").agg(F.sum("v").alias("v"))


def uniform(stems: DataFrame, bins: int) -> DataFrame:
    return stems.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(1.0).alias("v"))


def dense(tdist: DataFrame, key: str) -> DataFrame:
    """(key, values from bin 0 to the last, norm): a row a distribution."""
    held = tdist.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    last = F.array_max(F.map_keys("m"))
    values = F.transform(F.sequence(F.lit(0).cast("int"), last), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))
    return held.select(key, values.alias("values"), "norm")


def cosine(tdist: DataFrame, key: str = "stem") -> DataFrame:
    """(src, trg, score) of pairs that share a bin; all others score 0.

    A distribution is one array and its norm is made once; a pair is one dot product of two arrays, so that the number of
    bins is not the number of tasks.
    """
    src, trg = (dense(tdist.where(F.col("side") == s).select(F.col(key).alias(s), F.col("bin").cast("int").alias("bin"), "v"), s) for s in ("src", "trg"))
    met = product(trg, src.select("src", F.col("values").alias("own"), F.col("norm").alias("own_norm")))
    dot = F.aggregate(F.zip_with("own", "values", lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return met.select("src", "trg", dot.alias("dot"), (F.col("own_norm") * F.col("norm")).alias("both")).where("dot <> 0").select("src", "trg", (F.col("dot") / F.col("both")).alias("score"))
