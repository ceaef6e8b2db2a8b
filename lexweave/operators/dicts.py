"""Translation dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.draws import drawn
from .vocab import most_frequent


def clean(entries: DataFrame) -> DataFrame:
    """Lower-cased distinct entries (src, trg); those with digits, stars, commas, dots or underscores on either side go."""
    low = entries.select(F.lower(F.trim("src")).alias("src"), F.lower(F.trim("trg")).alias("trg"))
    return low.where(~F.col("src").rlike(X.DICTIONARY_NOISE) & ~F.col("trg").rlike(X.DICTIONARY_NOISE)).distinct()


def zip_lines(src_lines: DataFrame, trg_lines: DataFrame) -> DataFrame:
    """Entries from two files of equal lines: both are (line_no, line)."""
    return src_lines.select("line_no", F.col("line").alias("src")).join(trg_lines.select("line_no", F.col("line").alias("trg")), "line_no").select("src", "trg")


def rank_dictionary(vocab: DataFrame, size: int) -> DataFrame:
    """The r-th most frequent source word beside the r-th target word, for r up to ``size``: (src, trg, rn)."""
    top = most_frequent(vocab, size)
    src, trg = (top.where(F.col("side") == s).select("rn", F.col("stem").alias(s)) for s in ("src", "trg"))
    return src.join(trg, "rn").select("src", "trg", "rn")


def identity_dictionary(vocab: DataFrame) -> DataFrame:
    """Words spelled alike on both sides."""
    both = vocab.where("side = 'src'").select("stem").intersect(vocab.where("side = 'trg'").select("stem"))
    return both.select(F.col("stem").alias("src"), F.col("stem").alias("trg"))


def probabilistic(dictionary: DataFrame) -> DataFrame:
    """(src, trg, prob): rank r goes to the target of rank r with 0.7 and to that of r + 1 with 0.3."""
    after = dictionary.select((F.col("rn") - 1).alias("rn"), F.col("trg").alias("next"))
    joined = dictionary.join(after, "rn", "left")
    entries = F.array(F.struct(F.col("trg").alias("trg"), F.lit(0.7).alias("prob")), F.struct(F.col("next").alias("trg"), F.lit(0.3).alias("prob")))
    return joined.select("src", F.explode(entries).alias("e")).select("src", "e.trg", "e.prob").where("trg is not null")


def last_probability(entries: DataFrame) -> DataFrame:
    """Of entries (line_no, src, trg, prob) the last probability of each pair."""
    return entries.groupBy("src", "trg").agg(F.max_by("prob", "line_no").alias("prob"))


def resolve(dictionary: DataFrame, vocab: DataFrame, need_target: bool = True) -> DataFrame:
    """Entries whose source (and target, if needed) is in the vocabulary, with counts; a target off it keeps its word."""
    src, trg = (vocab.where(F.col("side") == s).select(F.col("stem").alias(s), F.col("n").alias(f"{s}_n")) for s in ("src", "trg"))
    return dictionary.select("src", "trg").join(src, "src").join(trg, "trg", "inner" if need_target else "left").select("src", "trg", "src_n", "trg_n")


def prune(dictionary: DataFrame, translations: int) -> DataFrame:
    """Drops sources with ``translations`` or more of them; below 0 nothing is dropped."""
    if translations < 0:
        return dictionary
    few = dictionary.groupBy("src").agg(F.count("*").alias("k")).where(F.col("k") < translations).select("src")
    return dictionary.join(few, "src", "left_semi")


def members(vocab: DataFrame, dictionary: DataFrame, inside: bool = True) -> DataFrame:
    """Classes in (or not in) the dictionary, sources on the source side, targets on the other."""
    known = dictionary.select(F.lit("src").alias("side"), F.col("src").alias("stem")).unionByName(dictionary.select(F.lit("trg").alias("side"), F.col("trg").alias("stem"))).distinct()
    return vocab.join(known, ["side", "stem"], "left_semi" if inside else "left_anti")


def keep_sources(dictionary: DataFrame, sources: DataFrame, keep: bool = True) -> DataFrame:
    """Entries whose source is (or is not) among sources (src)."""
    return dictionary.join(sources.select("src").distinct(), "src", "left_semi" if keep else "left_anti")


def split(dictionary: DataFrame, share: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two parts of the dictionary by sources, decided by a hash of the source alone."""
    inside = drawn(share, "src", seed=seed)
    return dictionary.where(inside), dictionary.where(~inside)


def first_target(dictionary: DataFrame) -> DataFrame:
    """(src, trg) with the least target of each source."""
    return dictionary.groupBy("src").agg(F.min("trg").alias("trg"))


def accents(vocab: DataFrame) -> DataFrame:
    """A transliteration dictionary of words with accents: each beside its plain form."""
    plain = F.translate("stem", "éèêàçùôîâ", "eeeacuoia")
    return vocab.select(F.col("stem").alias("src"), plain.alias("trg")).where("src <> trg").distinct()
