"""Phrase order: which phrases stand before, after and near others, and what that says about reordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.draws import drawn
from . import matcher as M
from .sizes import held

SENTENCE = ["side", "doc", "line_no", "sent_no"]
THIRD = "0.333333"


def spaced_rows(corpus: DataFrame, one_a_line: bool = False) -> DataFrame:
    """Sentences with their lower-cased tokens and the widths of the gaps after them: SENTENCE, toks, gaps."""
    sents = corpus.select("side", "doc", "line_no", F.posexplode(X.phrase_sentences(F.col("line"), one_a_line)).alias("sent_no", "sent"))
    sents = sents.where(X.has_tokens(F.col("sent"))).withColumn("sent", F.trim("sent"))
    gaps = F.transform(F.regexp_extract_all("sent", F.lit(r"\s+"), F.lit(0)), F.length)
    return sents.select(*SENTENCE, F.transform(X.tokens(F.col("sent")), F.lower).alias("toks"), gaps.alias("gaps"))


def neighbour_counts(corpus: DataFrame, phrases: DataFrame, longest: int = 3, gap: int = 2, longest_only: bool = True, one_a_line: bool = False) -> DataFrame:
    """(side, phrase, rel, ctx_phrase, n) as from neighbours(), for listed phrases (side, phrase) of a corpus.

    Phrases that a trie of bounded size holds are found and met inside each sentence, so nothing but counts is shuffled; of
    more phrases the occurrences meet in joins.
    """
    trie = M.trie_of(phrases)
    if trie is None:
        return neighbours(occurrences(corpus, phrases, longest, one_a_line), gap, longest_only)
    return M.neighbour_counts(spaced_rows(corpus, one_a_line).select("side", "toks", "gaps"), trie, longest, gap, longest_only)


def occurrences(corpus: DataFrame, phrases: DataFrame, longest: int = 3, one_a_line: bool = False) -> DataFrame:
    """Spans of listed phrases (side, phrase) with the widths of the gaps around them: SENTENCE, pos, n_tok, phrase, gap_before, gap_after."""
    found = spaced_rows(corpus, one_a_line).select(*SENTENCE, "gaps", F.explode(X.ngrams(F.col("toks"), longest)).alias("g"))
    found = found.select(*SENTENCE, "g.pos", F.col("g.n").alias("n_tok"), F.col("g.text").alias("phrase"), F.get("gaps", F.col("g.pos") - 1).alias("gap_before"), F.get("gaps", F.col("g.pos") + F.col("g.n") - 1).alias("gap_after"))
    return found.join(held(phrases.select("side", "phrase")), ["side", "phrase"], "left_semi")


def neighbours(found: DataFrame, gap: int = 2, longest_only: bool = True) -> DataFrame:
    """(side, phrase, rel, ctx_phrase, n): for each occurrence one phrase before, one after and, on the target side, one near
    but not adjacent (at most ``gap`` tokens between). Adjacent means one character apart.

    Neighbours meet in equi joins on sentence and token position, with a row for each gap width.
    """
    own = found.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(gap))))
    other = found.select(*SENTENCE, F.col("pos").alias("o_pos"), F.col("n_tok").alias("o_n"), F.col("phrase").alias("ctx_phrase"))
    left = own.withColumn("at", F.col("pos") - F.col("g")).join(other.withColumn("at", F.col("o_pos") + F.col("o_n")), [*SENTENCE, "at"])
    left = left.withColumn("rel", F.when((F.col("g") == 0) & (F.col("gap_before") == 1), "before").otherwise("disc"))
    right = own.withColumn("at", F.col("pos") + F.col("n_tok") + F.col("g")).join(other.withColumn("at", F.col("o_pos")), [*SENTENCE, "at"])
    right = right.withColumn("rel", F.when((F.col("g") == 0) & (F.col("gap_after") == 1), "after").otherwise("disc"))
    met = left.unionByName(right).where("rel <> 'disc' or side = 'trg'")
    order = F.struct(F.col("o_n"), -F.col("o_pos")) if longest_only else F.struct(F.col("o_pos"), F.col("o_n"))
    one = met.groupBy(*SENTENCE, "pos", "n_tok", "phrase", "rel").agg(F.max_by("ctx_phrase", order).alias("ctx_phrase"))
    return one.groupBy("side", "phrase", "rel", "ctx_phrase").agg(F.count("*").alias("n"))


def sample(pctx: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """Keeps a share of the neighbours, decided by a hash of phrase and neighbour."""
    return pctx.where(drawn(share, "side", "phrase", "rel", "ctx_phrase", seed=seed))


def prune(pctx: DataFrame, counts: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` least frequent neighbours of each phrase and relation; counts: (side, phrase, n)."""
    known = pctx.join(counts.select("side", F.col("phrase").alias("ctx_phrase"), F.col("n").alias("ctx_total")), ["side", "ctx_phrase"])
    order = Window.partitionBy("side", "phrase", "rel").orderBy("ctx_total", "ctx_phrase")
    return known.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep).drop("rn", "ctx_total")


def scores(pctx: DataFrame, table: DataFrame, cap: int = 1000) -> DataFrame:
    """(src, trg, b_mono, b_swap, b_disc, a_mono, a_swap, a_disc) of each pair; a side without evidence is null.

    Over the ``cap`` most frequent neighbours of the source phrase on that side, the target phrase's counts of their
    translations before, after and near it are added up and made to add up to 1.
    """
    order = Window.partitionBy("phrase", "rel").orderBy(F.desc("n"), "ctx_phrase")
    src = pctx.where("side = 'src' and rel <> 'disc'").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap)
    trg = pctx.where("side = 'trg'").groupBy(F.col("phrase").alias("trg"), F.col("ctx_phrase").alias("t")).agg(*(F.sum(F.when(F.col("rel") == r, F.col("n")).otherwise(0)).alias(f"k_{r}") for r in ("before", "after", "disc")))
    pairs = table.select("src", "trg").distinct()
    met = pairs.join(src.select(F.col("phrase").alias("src"), "rel", F.col("ctx_phrase").alias("s")), "src")
    met = met.join(pairs.select(F.col("src").alias("s"), F.col("trg").alias("t")), "s").join(trg, ["trg", "t"])
    sums = met.groupBy("src", "trg").agg(*(F.sum(F.when(F.col("rel") == rel, F.col(f"k_{k}"))).cast("double").alias(f"{rel}_{k}") for rel in ("before", "after") for k in ("before", "after", "disc")))
    out = pairs.join(sums, ["src", "trg"], "left")
    cols = []
    for name, rel, mono, swap in (("b", "before", "before", "after"), ("a", "after", "after", "before")):
        total = F.col(f"{rel}_before") + F.col(f"{rel}_after") + F.col(f"{rel}_disc")
        cols += [F.when(total > 0, F.col(f"{rel}_{k}") / total).alias(f"{name}_{what}") for what, k in (("mono", mono), ("swap", swap), ("disc", "disc"))]
    return out.select("src", "trg", *cols)


def text_line(digits: int | None = None) -> Column:
    """``src ||| trg ||| m s d m s d``; a side without evidence is a third each."""
    def shown(c: str) -> Column:
        value = F.format_string(f"%.{digits}f", F.col(c)) if digits is not None else F.col(c).cast("string")
        return F.when(F.col(c).isNull(), F.lit(THIRD)).otherwise(value)
    return F.concat_ws(" ||| ", "src", "trg", F.concat_ws(" ", *(shown(f"{s}_{k}") for s in "ba" for k in ("mono", "swap", "disc"))))
