"""Phrase table scoring from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dicts as D
from ..operators import lsh as S
from ..operators import phrases as P
from ..operators import reorder as O
from .fixtures import Induction


def lexical_features(i: Induction) -> DataFrame:
    """(src, trg, lex_context, lex_time)"""
    scores = i.pair_scores(i.token_pairs)
    out = [P.lexical(i.table, i.listed, scores[k], f"lex_{k}") for k in ("context", "time")]
    return out[0].join(out[1], ["src", "trg"])


def phrase_features(i: Induction) -> DataFrame:
    """(src, trg, fwd, bwd, ph_context, ph_time)"""
    scores = i.pair_scores(i.table)
    return P.features(i.table, ph_context=scores["context"], ph_time=scores["time"])


def scored_table(i: Induction) -> DataFrame:
    """The table with all monolingual features and the phrase penalty."""
    edit = P.lexical_edit(i.table, D.first_target(D.accents(i.vocab.where("side = 'src'"))))
    out = phrase_features(i).join(lexical_features(i), ["src", "trg"], "left").join(edit, ["src", "trg"], "left")
    return out.withColumn("penalty", F.lit(P.PENALTY))


def order_counts(i: Induction, longest_only: bool = True) -> DataFrame:
    return O.neighbour_counts(i.corpus, i.listed, i.p.ngram, i.p.gap, longest_only)


def order_scores(i: Induction) -> DataFrame:
    return O.scores(order_counts(i), i.table, i.p.neighbours)


def signature_dump(i: Induction) -> DataFrame:
    """(side, stem, context, time): packed signatures of the listed phrases."""
    ctx = S.signatures(i.phrase_context.select("side", "stem", F.col("ctx").alias("feature"), F.col("ctx_n").alias("v")))
    time = S.signatures(i.phrase_time_vectors.select("side", "stem", F.col("dim").cast("string").alias("feature"), "v"))
    return ctx.select("side", "stem", S.packed(F.col("sig")).alias("context")).join(time.select("side", "stem", S.packed(F.col("sig")).alias("time")), ["side", "stem"], "full")
