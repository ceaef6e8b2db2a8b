"""Edit distance scorers. Smaller is better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import is_few

#: Blocks that a larger smaller side is dealt to.
BLOCKS = 64


def product(many: DataFrame, few: DataFrame) -> DataFrame:
    """All pairs of rows. The second side is counted: up to FEW rows every task gets it, beyond that its rows lie in blocks,
    to each of which the first side goes, so that no task holds a whole side."""
    if is_few(few):
        return many.join(F.broadcast(few), how="cross")
    dealt = few.withColumn("block", F.pmod(F.xxhash64(*few.columns), F.lit(BLOCKS)))
    sent = many.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    return sent.join(dealt.hint("merge"), "block").drop("block")


def pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """All pairs of sources with all targets: both have stem."""
    return product(targets.select(F.col("stem").alias("trg")), sources.select(F.col("stem").alias("src")))


def distance(some: DataFrame) -> DataFrame:
    return some.select("src", "trg", F.levenshtein("src", "trg").cast("double").alias("score"))


def class_distance(a: Column, b: Column) -> Column:
    """Mean distance over all pairs of words of two classes."""
    each = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.levenshtein(x, y).cast("double"))))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(each)


def translit_distance(some: DataFrame, translit: DataFrame) -> DataFrame:
    """A known source word is replaced by its transliteration; else a known target word is. translit: (src, trg), one a word."""
    on_src = translit.select(F.col("src"), F.col("trg").alias("t_src"))
    on_trg = translit.select(F.col("src").alias("trg"), F.col("trg").alias("t_trg"))
    known = some.join(on_src, "src", "left").join(on_trg, "trg", "left")
    a = F.coalesce("t_src", "src")
    b = F.when(F.col("t_src").isNull(), F.coalesce("t_trg", "trg")).otherwise(F.col("trg"))
    return known.select("src", "trg", F.levenshtein(a, b).cast("double").alias("score"))


def per_letter(a: Column, b: Column) -> Column:
    """Distance by mean length, the feature of token pairs."""
    return F.levenshtein(a, b) / ((F.length(a) + F.length(b)) / 2.0)
