"""Lexicon induction from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edit as E
from ..operators import ranking as R
from ..operators import vocab as V
from ..params import DEFAULTS, Params
from .fixtures import Induction


def context_ranking(i: Induction, scorer: str = "s1") -> DataFrame:
    return R.rank(i.best_context(scorer), i.p.keep, threshold=0.0)


def time_ranking(i: Induction) -> DataFrame:
    filled = R.fill_zeros(i.best_time, i.sources, i.targets, i.p.keep)
    return R.rank(filled, i.p.keep)


def edit_ranking(i: Induction) -> DataFrame:
    return R.rank(i.best_edit, i.p.keep, smaller_better=True)


def fused_ranking(i: Induction) -> DataFrame:
    fused = R.fuse([context_ranking(i), time_ranking(i), edit_ranking(i)])
    return R.rank(fused.withColumn("score", F.round("score", 9)), i.p.keep)


def n_best(spark: SparkSession, sf_dir: str, p: Params = DEFAULTS) -> DataFrame:
    """Fused n-best lists of the most frequent source words."""
    return fused_ranking(Induction(spark, sf_dir, p))


def induce_lists(spark: SparkSession, sf_dir: str, sources: DataFrame, targets: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Context rankings of given source words among given candidates, lists of stem. Words without a context don't come up."""
    i = Induction(spark, sf_dir, p)
    sides = (("src", sources), ("trg", targets))
    src, trg = (i.vocab.where(F.col("side") == side).join(words.select("stem").distinct(), "stem", "left_semi").select("side", "stem", "n") for side, words in sides)
    return context_ranking(i.of(src, trg))


def binned_sources(i: Induction, bins: int = 4, sample: int = 40) -> DataFrame:
    """A sample of source words of each frequency bin: (stem, n, bin)."""
    usable = i.vocab.where("side = 'src'").where(V.occurs(fewer_than=3, more_than=10000))
    return R.frequency_bins(usable.select("stem", "n"), bins, sample)


#: Rankings of an induction by name; fused is made of all others.
RANKINGS = {"time": time_ranking, "context": context_ranking, "edit": edit_ranking}


def rankings_by_bin(i: Induction, bins: int = 4, sample: int = 40, names: tuple[str, ...] = (*RANKINGS, "fused")) -> dict[str, DataFrame]:
    """The named rankings of the words of each bin: bin, src, trg, score, rk. Only what they need is made, since times and
    contexts each take a run over the texts."""
    binned = binned_sources(i, bins, sample).persist()
    j = i.of(binned.select(F.lit("src").alias("side"), "stem", "n"), i.targets)
    made = {name: ranking(j) for name, ranking in RANKINGS.items() if name in names or "fused" in names}
    if "fused" in names:
        made["fused"] = R.rank(R.fuse(list(made.values())).withColumn("score", F.round("score", 9)), i.p.keep)
    named = binned.select(F.col("stem").alias("src"), "bin")
    return {name: made[name].join(named, "src").select("bin", "src", "trg", "score", "rk") for name in names}


def by_frequency(spark: SparkSession, sf_dir: str, bins: int = 4, sample: int = 40, p: Params = DEFAULTS) -> DataFrame:
    """Context rankings of a sample of source words from each frequency bin: bin, src, trg, score, rk."""
    return rankings_by_bin(Induction(spark, sf_dir, p), bins, sample, ("context",))["context"]


def accuracy_by_bin(i: Induction, names: tuple[str, ...] = ("time", "context", "edit", "fused")) -> DataFrame:
    """(ranking, bin, k, accuracy, in_dict): the evaluation of each ranking within each frequency bin."""
    made, out = rankings_by_bin(i, names=names), None
    for name in names:
        one = R.accuracy(made[name], i.dictionary, i.p.ks, keys=("bin",)).withColumn("ranking", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def score_token_pairs(spark: SparkSession, sf_dir: str, p: Params = DEFAULTS) -> DataFrame:
    """Features of every source with every target token: src, trg, ph_context, ph_time, lex_context, lex_time, lex_edit."""
    from ..operators import phrases as P

    i = Induction(spark, sf_dir, p)
    pairs = E.pairs(i.sources, i.targets)
    return P.token_features(P.features(pairs, ph_context=i.context_scores(), ph_time=i.time_scores))
