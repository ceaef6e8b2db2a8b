"""Languages by rank profiles of character n-grams, learnt from texts of known language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matcher import BATCH

#: Characters of the longest n-gram, n-grams of a profile.
LONGEST, SIZE = 3, 300
#: Profiles that are held against every text: codes of languages, not an open set.
LANGUAGES = 1000
#: Bits of a code point.
BITS = 21
#: Characters whose n-grams are counted at once; a hundred bytes each are needed meanwhile.
PART = 1 << 18
#: Counts of a text and an n-gram kept as a table, 32 MB; more are sorted.
DENSE = 1 << 22
#: Counts of languages' n-grams that a task holds before it sends them.
HELD = 1 << 19
#: A language is reliably told from this many distinct n-grams on, if the next one is a fiftieth further away.
LEAST, LEAD = 20, 50


def letters(text: Column) -> Column:
    """Lower-cased words with one blank between, before and after them; null and letterless texts are empty."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and how many each has."""
    plain = texts.to_pylist()
    return np.frombuffer("".join(plain).encode("utf-32-le"), np.int32), np.array([len(t) for t in plain], np.int64)


def count_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, n): the n-grams of each text, as numbers that sort like them; PART characters are looked at at once,
    so that a text of any length takes little memory beside its distinct n-grams."""
    codes, size = _codes(texts)
    ends = np.cumsum(size)
    found = [_count_part(codes, ends, at, min(at + PART, len(codes))) for at in range(0, max(len(codes), 1), PART)]
    return found[0] if len(found) == 1 else _sum([np.concatenate(x) for x in zip(*found, strict=True)])


def _count_part(codes: np.ndarray, ends: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """count_grams of those that begin at a character from ``first`` to before ``last``."""
    some = np.append(codes[first : last + LONGEST - 1], np.zeros(LONGEST - 1, np.int32)).astype(np.int64)
    place = np.arange(first, last)
    row = np.searchsorted(ends, place, "right")
    left = ends[row] - place  # characters from here to the end
    key, keys, rows = np.zeros(last - first, np.int64), [], []
    for n in range(LONGEST):
        key = key + (some[n : n + last - first] << BITS * (LONGEST - 1 - n))
        whole = left > n
        keys.append(key[whole])
        rows.append(row[whole])
    row, grams = np.concatenate(rows), pa.array(np.concatenate(keys)).dictionary_encode()
    known, gram = grams.dictionary.to_numpy(), grams.indices.to_numpy().astype(np.int64)
    low, width = row.min(initial=len(ends)), max(len(known), 1)
    both = (row - low) * width + gram
    if both.max(initial=0) < DENSE:
        every = np.bincount(both)
        both = np.flatnonzero(every)
        n = every[both]
    else:
        both, n = np.unique(both, return_counts=True)
    row, gram = np.divmod(both, width)
    return row + low, known[gram], n


def _sum(counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, gram, n) with a row for each key and gram, in their order."""
    key, gram, n = counts
    order = np.lexsort((gram, key))
    key, gram, n = key[order], gram[order], n[order]
    first = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(gram, prepend=-1) != 0))
    return key[first], gram[first], np.add.reduceat(n, first) if len(first) else n


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch's rows in slices whose texts have about PART bytes together, or a row each where one is longer; at most BATCH rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, before + PART, "right")), at + 1), at + BATCH)
        yield batch.slice(at, to - at)
        at = to


def learn(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(lang, gram, rk): the ``size`` most frequent n-grams of each language of (lang, text), by falling count. Each task adds
    up counts, HELD at a time, before it sends them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed() -> list[np.ndarray]:
            return list(_sum([np.concatenate(x) for x in zip(*waiting, strict=True)]))

        def sent(counts: list[np.ndarray]) -> pa.RecordBatch:
            langs = pa.array(list(number), pa.string())
            return pa.RecordBatch.from_arrays([langs.take(pa.array(counts[0])), pa.array(counts[1]), pa.array(counts[2])], ["lang", "gram", "n"])

        for batch in batches:
            for part in parts(batch, 1):
                row, gram, n = count_grams(part.column(1))
                lang = np.array([number.setdefault(x, len(number)) for x in part.column(0).to_pylist()], np.int64)
                waiting.append(_sum([lang[row], gram, n]))
                if sum(len(w[0]) for w in waiting) > 2 * HELD:
                    waiting = [tuple(summed())]
                    if len(waiting[0][0]) > HELD:
                        yield sent(list(waiting.pop()))
        if waiting:
            yield sent(summed())

    rows = docs.where("lang is not null").select("lang", letters(F.col("text")).alias("text"))
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= size).select("lang", "gram", "rk")


def most_frequent(row: np.ndarray, gram: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, rank): each row's ``size`` most frequent n-grams, ties by n-gram. Row, count and n-gram, numbered in their
    order, are sorted as one number."""
    known, number = np.unique(gram, return_inverse=True)
    most, width = int(n.max(initial=0)) + 1, max(len(known), 1)
    key = np.sort((row * most + (most - 1 - n)) * width + number)
    row, number = key // (most * width), key % width
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    top = rank <= size
    return row[top], known[number[top]], rank[top]


def tell(texts: DataFrame, profiles: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """The other columns of ``texts`` with lang, distance and reliable: the nearest language, null where a text has no letters.

    A text's ``size`` most frequent n-grams count how far their ranks are from those of a profile, ``size`` where it lacks
    them. Ties go to the first code. Whole texts are counted; nothing is shuffled. Profiles are a few hundred numbers a
    language and go to every task; more than LANGUAGES are an error.
    """
    known: dict[str, list[tuple[int, int]]] = {}
    for r in profiles.limit(LANGUAGES * size + 1).collect():
        known.setdefault(r.lang, []).append((r.gram, r.rk))
    if len(known) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = sorted(known)
    tables = [tuple(np.array(x, np.int64) for x in zip(*sorted(known[lang]), strict=True)) for lang in langs]
    kept = [c for c in texts.columns if c != text]
    told = [T.StructField("lang", T.StringType()), T.StructField("distance", T.LongType()), T.StructField("reliable", T.BooleanType())]
    schema = T.StructType([*texts.select(*kept).schema.fields, *told])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, gram, rank = most_frequent(*count_grams(batch.column(len(kept))), size)
        far = np.zeros((len(langs), batch.num_rows), np.int64)
        for k, (grams, ranks) in enumerate(tables):
            at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            far[k] = np.bincount(row, np.where(grams[at] == gram, abs(ranks[at] - rank), size), batch.num_rows)
        distinct = np.bincount(row, minlength=batch.num_rows)
        empty = (distinct == 0) | (len(langs) == 0)
        best = far.argmin(axis=0) if langs else np.zeros(batch.num_rows, np.int64)
        least = far.min(axis=0) if langs else best
        next_ = np.partition(far, 1, axis=0)[1] if len(langs) > 1 else np.full(batch.num_rows, 1 << 40)
        lang = pa.array([None if e else langs[b] for b, e in zip(best.tolist(), empty.tolist(), strict=True)], pa.string())
        sure = ~empty & (distinct >= LEAST) & (LEAD * (next_ - least) >= least)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], lang, pa.array(least, pa.int64(), mask=empty), pa.array(sure)], schema.names)

    def told_by_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, len(kept)):
                yield run(part)

    return texts.select(*kept, letters(F.col(text)).alias(text)).mapInArrow(told_by_parts, schema)
