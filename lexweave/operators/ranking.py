"""Rankings of candidates, their fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import order_of


def rank(scores: DataFrame, keep: int, threshold: float | None = None, smaller_better: bool = False, keys: tuple[str, ...] = ("src",)) -> DataFrame:
    """The ``keep`` best targets of each source, with average ranks of ties among those kept: keys, trg, score, rk.

    With a threshold only strictly better scores count. Beyond ``keep`` ties are cut by the target's spelling.
    """
    if threshold is not None:
        scores = scores.where(F.col("score") < threshold if smaller_better else F.col("score") > threshold)
    order = F.asc("score") if smaller_better else F.desc("score")
    cut = scores.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "trg"))).where(F.col("rn") <= keep)
    better = F.rank().over(Window.partitionBy(*keys).orderBy(order))
    ties = F.count("*").over(Window.partitionBy(*keys, "score"))
    return cut.select(*keys, "trg", "score", (better + (ties - 1) / 2.0).alias("rk"))


def fill_zeros(scores: DataFrame, sources: DataFrame, targets: DataFrame, keep: int) -> DataFrame:
    """Adds score 0 for sources with fewer than ``keep`` scored targets, for the targets that a ranking would take.

    At most 2 * keep targets by spelling can be wanted, so the few sources concerned meet those alone.
    """
    counts = scores.where("score > 0").groupBy("src").agg(F.count("*").alias("k"))
    short = sources.select(F.col("stem").alias("src")).join(counts, "src", "left").where(F.coalesce("k", F.lit(0)) < keep).select("src")
    first = targets.select(F.col("stem").alias("trg")).orderBy("trg").limit(2 * keep)
    wanted = short.join(F.broadcast(first), how="cross").join(scores.where("score > 0"), ["src", "trg"], "left_anti")
    return scores.where("score > 0").unionByName(wanted.withColumn("score", F.lit(0.0)))


def best(ranking: DataFrame) -> DataFrame:
    """(src, trg, score): a best candidate of each source, the first by spelling."""
    return ranking.groupBy("src").agg(F.min(F.struct("rk", "trg", "score")).alias("b")).select("src", "b.trg", "b.score")


def random_candidate(ranking: DataFrame, seed: int = 1) -> DataFrame:
    """(src, trg, score): of each source the candidate that comes first by a hash of the pair."""
    draw = order_of("src", "trg", seed=seed)
    return ranking.groupBy("src").agg(F.min(F.struct(draw.alias("h"), "trg", "score")).alias("b")).select("src", "b.trg", "b.score")


def within(ranking: DataFrame, lower: float, upper: float) -> DataFrame:
    return ranking.where(F.col("score").between(lower, upper))


def rerank(ranking: DataFrame, scores: DataFrame, threshold: float | None = None, smaller_better: bool = False) -> DataFrame:
    """The candidates of a ranking in the order of another scorer's scores."""
    return rank(scores.join(ranking.select("src", "trg"), ["src", "trg"], "left_semi"), 1 << 30, threshold, smaller_better)


def fuse(rankings: list[DataFrame]) -> DataFrame:
    """Mean reciprocal rank over all rankings; a target that one lacks has 0 from it. (src, trg, score)"""
    every = rankings[0].select("src", "trg", "rk")
    for r in rankings[1:]:
        every = every.unionByName(r.select("src", "trg", "rk"))
    return every.groupBy("src", "trg").agg((F.sum(1 / F.col("rk")) / len(rankings)).alias("score"))


def gold_ranks(ranking: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, src, best_rk) of every source that has gold translations; best_rk is null where none was listed."""
    listed = ranking.select(*keys, "src").distinct()
    answers = ranking.join(gold.select("src", "trg").distinct(), ["src", "trg"]).groupBy(*keys, "src").agg(F.min("rk").alias("best_rk"))
    return listed.join(gold.select("src").distinct(), "src", "left_semi").join(answers, [*keys, "src"], "left")


def accuracy(ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k, accuracy, in_dict): per cent of the sources with gold that have one among their top k."""
    found = gold_ranks(ranking, gold, keys).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.when(F.col("best_rk") <= F.col("k"), 1.0).otherwise(0.0)
    return found.groupBy(*keys, "k").agg(F.round(100 * F.avg(hit), 2).alias("accuracy"), F.count("*").alias("in_dict"))


def numbered(df: DataFrame, *order) -> tuple[DataFrame, int]:
    """The rows with their number rn from 1 in an order, and how many there are; each task numbers a range.

    The ranges are kept while the plan lives, since they come from a sample; their sizes, a row a range, add up on the driver.
    """
    parts = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).persist()
    before, starts = 0, []
    for r in parts.groupBy("part").agg(F.count("*").alias("k")).orderBy("part").collect():
        starts.append((r.part, before))
        before += r.k
    first = df.sparkSession.createDataFrame(starts, "part int, before long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("rn", own).join(F.broadcast(first), "part").withColumn("rn", F.col("rn") + F.col("before")).drop("part", "before"), before


def frequency_bins(vocab: DataFrame, bins: int, sample: int | None = None) -> DataFrame:
    """Classes in bins of equal numbers by falling count, the remainder dropped: (stem, n, bin). A sample is taken by a hash."""
    ranked, size = numbered(vocab, F.desc("n"), F.asc("stem"))
    per = size // bins
    if not per:
        return ranked.select("stem", "n", F.lit(0).alias("bin")).limit(0)
    binned = ranked.withColumn("bin", F.floor((F.col("rn") - 1) / per).cast("int")).where(F.col("bin") < bins)
    if sample is not None:
        order = Window.partitionBy("bin").orderBy(F.md5("stem"), "stem")
        binned = binned.withColumn("k", F.row_number().over(order)).where(F.col("k") <= min(sample, size) // bins)
    return binned.select("stem", "n", "bin")


def count_bands(vocab: DataFrame, lower: int, upper: int, bands: int) -> DataFrame:
    """Classes in bands of equal width by count: (stem, n, band)."""
    inside = vocab.where((F.col("n") >= lower) & (F.col("n") < upper))
    return inside.select("stem", "n", F.width_bucket(F.col("n").cast("double"), F.lit(float(lower)), F.lit(float(upper)), F.lit(bands)).alias("band"))


def dump(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """(src, score, line): a set of tied candidates as text, starred if it holds a gold translation."""
    marked = ranking.join(gold.select("src", "trg").distinct().withColumn("g", F.lit(1)), ["src", "trg"], "left")
    sets = marked.groupBy("src", "score").agg(F.sort_array(F.collect_list("trg")).alias("c"), F.max("g").alias("g"))
    star = F.when(F.col("g") == 1, F.lit("* ")).otherwise(F.lit(""))
    return sets.select("src", "score", F.concat(star, F.array_join("c", " ")).alias("line"))
