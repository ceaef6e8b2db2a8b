"""Context vectors: collection, projection through dictionaries, weights and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .counting import count_contexts, few_stems
from .sizes import FEW_ENTRIES, held


def collect(sents: DataFrame, stems: DataFrame, words: DataFrame, left: int = 2, right: int = 2, positions: bool = False) -> DataFrame:
    """(side, stem, ctx, ctx_n, corp_n): how often a context word of ``words`` (side, stem, n) stands near each of ``stems``.

    sents: side and toks, or text, whole texts to split. Neighbours are found inside each sentence's array, without a
    self-join. The context words, as few as the dictionary, go to every task, as do the classes of a side that has few, and
    pairs are counted there before any is sent; other classes are looked up among the counts. More context words are looked up
    by a join, which takes sentences with toks.
    """
    if (near := count_contexts(sents, words, left, right, few_stems(stems), positions)) is not None:
        counted = near.join(stems.select("side", "stem"), ["side", "stem"], "left_semi")
        plain = F.substring_index("ctx", "|s:", 1) if positions else F.col("ctx")
        known = words.select("side", F.col("stem").alias("plain"), F.col("n").cast("double").alias("corp_n"))
        return counted.withColumn("plain", plain).join(F.broadcast(known), ["side", "plain"]).select("side", "stem", "ctx", "ctx_n", "corp_n")
    windows = (X.window_words_at if positions else X.window_words)(F.col("toks"), left, right)
    near = sents.select("side", F.explode(windows).alias("w")).select("side", "w.stem", "w.around")
    pairs = near.select("side", "stem", F.explode("around").alias("ctx"))
    plain = F.substring_index("ctx", "|s:", 1) if positions else F.col("ctx")
    known = words.select("side", F.col("stem").alias("plain"), F.col("n").alias("corp_n"))
    found = pairs.withColumn("plain", plain).join(held(known), ["side", "plain"])
    counted = found.groupBy("side", "stem", "ctx").agg(F.count("*").cast("double").alias("ctx_n"), F.max("corp_n").cast("double").alias("corp_n"))
    return counted.join(stems.select("side", "stem"), ["side", "stem"], "left_semi")


def prune(ctx: DataFrame, keep: int, by: str = "ctx_n") -> DataFrame:
    """The ``keep`` strongest context words of each class."""
    order = Window.partitionBy("side", "stem").orderBy(F.desc(by), "ctx")
    return ctx.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep).drop("rn")


def project(ctx: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Source contexts as target words, a row a translation; with prob both counts are scaled by it."""
    src = ctx.where("side = 'src'")
    out = src.join(dictionary.withColumnRenamed("src", "ctx"), "ctx")
    if "prob" in dictionary.columns:
        out = out.withColumns({"ctx_n": F.col("ctx_n") * F.col("prob"), "corp_n": F.col("corp_n") * F.col("prob")})
    return out.select("side", "stem", F.col("trg").alias("ctx"), "ctx_n", "corp_n")


def idf_weight() -> Column:
    return F.col("ctx_n") * (F.ln(F.col("max_n") / F.col("corp_n")) + 1)


WEIGHTS = {"binary": lambda: F.lit(1.0), "count": lambda: F.col("ctx_n"), "idf": idf_weight}


def weigh(projected: DataFrame, totals: DataFrame, weight: str = "idf") -> DataFrame:
    """(side, stem, ctx, w); of several sources of one context word the largest weight stays. totals: (side, max_n).

    Only projected contexts can hold a word several times; the target side is as it was counted, a row a word, and stays.
    """
    weighted = projected.join(F.broadcast(totals.select("side", "max_n")), "side")  # a row a side
    weighted = weighted.select("side", "stem", "ctx", WEIGHTS[weight]().alias("w"))
    once = weighted.where("side <> 'trg'").groupBy("side", "stem", "ctx").agg(F.max("w").alias("w"))
    return once.unionByName(weighted.where("side = 'trg'"))


def dot_products(wctx: DataFrame) -> DataFrame:
    """(src, trg, dot, shared_trg, n_src, n_trg): sums over shared context words, and whole norms made once a vector.

    Pairs without a shared word don't come up: the join goes over context words, not over pairs. Target vectors are dealt by
    word once, for norms and sums alike. The vectors of the few sources go to every task, so that a context word of many
    targets is no hot key; where they are too many, both sides are shuffled by context word.
    """
    vectors = {}
    for s in ("src", "trg"):
        own = wctx.where(F.col("side") == s).select(F.col("stem").alias(s), "ctx", F.col("w").alias(f"w_{s}"))
        vectors[s] = own.withColumn(f"n_{s}", norm_of(f"w_{s}").over(Window.partitionBy(s)))
    met = vectors["trg"].join(held(vectors["src"], FEW_ENTRIES), "ctx")
    return met.groupBy("src", "trg").agg(F.sum(F.col("w_src") * F.col("w_trg")).alias("dot"), norm_of("w_trg").alias("shared_trg"), F.max("n_src").alias("n_src"), F.max("n_trg").alias("n_trg"))


def norm_of(column: str) -> Column:
    return F.sum(F.col(column) * F.col(column))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


SCORES = {
    "cosine": lambda: _ratio(F.col("dot"), F.sqrt(F.col("n_src") * F.col("n_trg"))),
    "dice": lambda: _ratio(2 * F.col("dot"), F.col("shared_trg") + F.col("n_src")),
    "dice_cosine": lambda: _ratio(F.col("dot") * F.col("dot"), F.sqrt(F.col("n_src") * F.col("shared_trg")) * (F.col("n_src") + F.col("shared_trg"))),
    "product": lambda: F.col("dot"),
}


def score(wctx: DataFrame, kind: str = "cosine") -> DataFrame:
    """(src, trg, score) of all pairs that share a context word; all other pairs score 0."""
    return dot_products(wctx).select("src", "trg", SCORES[kind]().alias("score"))


#: Scorers by name: (weight, score).
SCORERS = {"binary": ("binary", "cosine"), "s0": ("count", "cosine"), "s1": ("idf", "cosine"), "s2": ("idf", "dice"), "s3": ("idf", "dice_cosine"), "tfidf": ("idf", "product")}


def score_by_name(ctx: DataFrame, dictionary: DataFrame, totals: DataFrame, name: str = "s1") -> DataFrame:
    weight, kind = SCORERS[name]
    both = project(ctx, dictionary).unionByName(ctx.where("side = 'trg'").select("side", "stem", "ctx", "ctx_n", "corp_n"))
    return score(weigh(both, totals, weight), kind)


def common_topics(a: Column, b: Column) -> Column:
    """How many pairs of equal ids two arrays of topics make; ids that repeat count each time, null has none."""
    own = F.transform(a, lambda x: F.size(F.filter(b, lambda y: x == y)))
    return F.coalesce(F.aggregate(own, F.lit(0), lambda s, n: s + n), F.lit(0))
