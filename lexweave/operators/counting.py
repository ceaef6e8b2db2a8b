"""Counts of words and of words beside words, made a batch of sentences at a time before anything is opened into rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sizes, splitting
from .matcher import known_tokens


def _whole(rows: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in splitting.sentences(batches, names):
            yield fn(batch)

    return rows.mapInArrow(run, schema)


def _sentence(toks: pa.ListArray) -> np.ndarray:
    """The sentence of each token."""
    return np.repeat(np.arange(len(toks)), np.diff(toks.offsets.to_numpy()))


def _groups(keys: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row, the same for equal keys, and the first row of each number."""
    number = np.zeros(len(keys[0]), np.int64)
    for key in keys:
        codes = key.dictionary_encode(null_encoding="encode")
        number = number * max(len(codes.dictionary), 1) + codes.indices.to_numpy(zero_copy_only=False)
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    return number, first


def few_stems(stems: DataFrame) -> dict[str, list[str]]:
    """The stems (side, stem) of each side that has at most FEW of them; of other sides all words are counted."""
    rows = stems.groupBy("side").agg(F.count("*").alias("n")).collect()
    some = [r.side for r in rows if r.side is not None and r.n <= sizes.FEW]
    found = {side: [] for side in some}
    for r in stems.where(F.col("side").isin(some)).select("side", "stem").collect() if some else []:
        found[r.side].append(r.stem)
    return found


def _wanted(names: pa.Array, stems: dict[str, list[str]], sides: list[str]) -> np.ndarray:
    """Whether a word is counted, by side, the last of which is any other side, and word."""
    out = np.ones((len(sides) + 1, len(names)), bool)
    for side, some in stems.items():
        if side in sides:
            out[sides.index(side)] = pc.is_in(names, pa.array(some, pa.string())).to_numpy(zero_copy_only=False)
    return out


def _numbers(column: pa.Array, sides: list[str]) -> np.ndarray:
    return pc.fill_null(pc.index_in(column, pa.array(sides, pa.string())), len(sides)).to_numpy(zero_copy_only=False).astype(np.int64)


def count_words(sents: DataFrame, *keys: str, stems: dict[str, list[str]] | None = None) -> DataFrame:
    """(keys, stem, n): how often each word that isn't empty stands in the sentences of each key.

    sents: keys and toks, or text, whole texts to split. stems: the only words to count, of the sides (first key) that it names.
    """
    rows = sents.select(*keys, "toks" if "toks" in sents.columns else "text")
    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("stem", T.StringType()), T.StructField("n", T.LongType())])
    stems = stems or {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        toks = batch.column(len(keys))
        words = toks.flatten().dictionary_encode()
        word, width = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
        sentence = _sentence(toks)
        number, first = _groups([batch.column(k) for k in range(len(keys))])
        code = number[sentence] * width + word
        if stems:
            sides = sorted(stems)
            code = code[_wanted(words.dictionary, stems, sides)[_numbers(batch.column(0), sides)[sentence], word]]
        pair, counts = np.unique(code, return_counts=True)
        group, word = np.divmod(pair, width)
        stem = words.dictionary.take(pa.array(word))
        kept = pc.not_equal(stem, "")
        columns = [batch.column(k).take(pa.array(first[group])) for k in range(len(keys))]
        return pa.RecordBatch.from_arrays([*columns, stem, pa.array(counts, pa.int64())], schema.names).filter(kept)

    counted = _whole(rows, run, schema)
    return counted.groupBy(*keys, "stem").agg(F.sum("n").alias("n"))


def count_contexts(sents: DataFrame, words: DataFrame, left: int, right: int, stems: dict[str, list[str]] | None = None, positions: bool = False) -> DataFrame | None:
    """(side, stem, ctx, ctx_n): how often a word of ``words`` (side, stem) stands near each word, at most ``left`` words before
    or ``right`` words after it; with positions each distance for itself, which ctx tells. None where the context words are
    too many to go to every task. sents and stems as in count_words."""
    listed = words.select("side", "stem").distinct().limit(sizes.FEW + 1).collect()
    if len(listed) > sizes.FEW:
        return None
    sides = sorted({r.side for r in listed})
    near_words = sorted({r.stem for r in listed})
    known = np.zeros((len(sides) + 1, len(near_words) + 1), bool)  # the last of either: any other
    for r in listed:
        known[sides.index(r.side), near_words.index(r.stem)] = True
    shifts = [*range(-right, 0), *range(1, left + 1)]  # a word after stands that far before its neighbour
    tags = [f"|s:{-s}" for s in shifts] if positions else [""]
    names = pa.array([w + tag for tag in tags for w in near_words], pa.string())
    stems = stems or {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        toks = batch.column(1)
        side = _numbers(batch.column(0), sides)
        sentence, near = _sentence(toks), known_tokens(toks, near_words)
        own = side[sentence]
        at = np.flatnonzero(known[own, near])  # only places of context words are looked at
        all_words = toks.flatten().dictionary_encode()
        word, size = all_words.indices.to_numpy().astype(np.int64), max(len(all_words.dictionary), 1)
        wanted, keys = _wanted(all_words.dictionary, stems, sides), []
        for k, shift in enumerate(shifts):
            here = at[(at + shift >= 0) & (at + shift < len(word))]
            here = here[sentence[here + shift] == sentence[here]]
            if stems:
                here = here[wanted[own[here], word[here + shift]]]
            ctx = near[here] + (k * len(near_words) if positions else 0)
            keys.append((own[here] * size + word[here + shift]) * max(len(names), 1) + ctx)
        pair, counts = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
        pair, ctx = np.divmod(pair, max(len(names), 1))
        s, stem = np.divmod(pair, size)
        columns = [pa.array(sides, pa.string()).take(pa.array(s)), all_words.dictionary.take(pa.array(stem)), names.take(pa.array(ctx)), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["side", "stem", "ctx", "n"])

    counted = _whole(sents.select("side", "toks" if "toks" in sents.columns else "text"), run, "side string, stem string, ctx string, n long")
    return counted.groupBy("side", "stem", "ctx").agg(F.sum("n").cast("double").alias("ctx_n"))
