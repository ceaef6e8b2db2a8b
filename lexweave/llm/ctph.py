"""Context-triggered piecewise hashing of texts (operator 5)."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, map_batches, map_slices, settle

#: Bytes that the rolling hash sees, smallest block size, most characters of the two signatures, shortest shared run.
WINDOW, SMALLEST, LONG, SHORT, RUN = 7, 3, 64, 32, 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes of a text that are looked at together.
BLOCK = 1 << 18
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5], np.uint32)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(2)
def powers(base: int) -> np.ndarray:
    """The powers of base from 0 up to BLOCK, modulo 2**64."""
    out = np.empty(BLOCK + 1, np.uint64)
    out[0], out[1:] = 1, np.uint64(base)
    return np.multiply.accumulate(out)


def marks(data: bytes, block_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of pieces for block_size: (end, rolling value + 1, prefix hash up to the end), block after block of the text."""
    ends, rolls, prefixes = [], [], []
    total, lift = np.uint64(0), 1
    for at in range(0, len(data), BLOCK):
        piece = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at)
        lead = np.zeros(WINDOW - 1, np.uint8)
        if at:
            lead = np.frombuffer(data, np.uint8, WINDOW - 1, at - WINDOW + 1)
        wide = np.concatenate([lead, piece]).astype(np.uint32)
        n = len(piece)
        roll = wide[:n] * _FACTORS[0]
        for j in range(1, WINDOW):
            roll += wide[j : j + n] * _FACTORS[j]
        roll ^= roll >> np.uint32(15)
        roll *= np.uint32(0x2C1B3C6D)
        roll >>= np.uint32(2)
        roll += np.uint32(1)
        sums = np.cumsum(piece.astype(np.uint64) * powers(_BASE)[:n] + powers(_BASE)[:n]) * np.uint64(lift) + total
        hit = np.flatnonzero(roll % np.uint32(block_size) == 0)
        ends.append(hit + at + 1)
        rolls.append(roll[hit])
        prefixes.append(sums[hit])
        total, lift = sums[-1], lift * pow(_BASE, n, 1 << 64) % (1 << 64)
    ends.append([len(data)])
    rolls.append([0])
    prefixes.append([total])
    return np.concatenate(ends).astype(np.int64), np.concatenate(rolls).astype(np.int64), np.concatenate(prefixes).astype(np.uint64)


def down(at: np.ndarray) -> np.ndarray:
    """Inverse powers at places of any size."""
    out = powers(_INVERSE)[at % BLOCK]
    for k in np.unique(at // BLOCK):
        if k:
            out[at // BLOCK == k] *= np.uint64(pow(_INVERSE, int(k) * BLOCK, 1 << 64))
    return out


def signature(found: tuple[np.ndarray, np.ndarray, np.ndarray], block_size: int, most: int) -> str:
    """A character a piece; what follows the last place is one piece."""
    ends, rolls, prefixes = found
    size = ends[-1]
    pick = np.flatnonzero((rolls % block_size == 0) & (ends < size))[: most - 1]
    stop, sums = np.append(ends[pick], size), np.append(prefixes[pick], prefixes[-1])
    start, before = np.append(0, stop[:-1]), np.append(np.uint64(0), sums[:-1])
    h = (sums - before) * down(start)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return "".join(ALPHABET[i] for i in (h >> np.uint64(58)).tolist())


def fingerprint(text: str) -> str:
    """``block size:signature:signature at twice the block size`` of the text's UTF-8 bytes."""
    data = text.encode("utf-8", "replace")
    if not data:
        return f"{SMALLEST}::"
    block = SMALLEST
    while block * LONG < len(data):
        block *= 2
    least = max(SMALLEST, block // 4)
    found = marks(data, least)
    while True:
        first = signature(found, block, LONG)
        if block == SMALLEST or len(first) >= LONG // 2:
            return f"{block}:{first}:{signature(found, 2 * block, SHORT)}"
        block //= 2
        if block < least:
            least = max(SMALLEST, block // 8)
            found = marks(data, least)


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word at a time."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & place.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def alike(a: str, b: str) -> float:
    """1 less the share of characters to insert or delete; 0 without a shared run of RUN characters, or all of a shorter one."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    have = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in have for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: the best likeness of signatures at a block size that both fingerprints have."""
    if a == b:
        return 1.0
    (n, a1, a2), (m, b1, b2) = a.split(":"), b.split(":")
    have, other = {int(n): a1, 2 * int(n): a2}, {int(m): b1, 2 * int(m): b2}
    return max((alike(have[k], other[k]) for k in have.keys() & other.keys()), default=0.0)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every whole text; a null text counts as empty."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "fingerprint": pa.array(list(map(fingerprint, texts)), pa.string())}

    return map_slices(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, n_chars long, fingerprint string", run)


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, kind string, text string"
_NAMES = [x.split()[0] for x in ROW.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]


def compare(doc_id, text: str, mine: str, after: str, next_print: str) -> tuple:
    """A result row: ``text`` with its second half replaced by the start of ``after``, against itself and ``after``."""
    n = len(text)
    edited = text[: n - n // 2] + after[: n // 2]
    changed = mine if edited == text else fingerprint(edited)
    return doc_id, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, next_print)


def edit_study(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and likeness to those and to the next document's.

    The next document is that of the next smaller id, after the last the first. Texts are dealt once into ranges of the
    id and read in order, so that neighbours meet; a range's first and last text go along with its rows, and the few last
    ones are finished from the first text of the range after.
    Very long texts are hashed block by block. Null texts count as empty; null ids come last; rows of one id are ordered by a hash of the text; a lone row follows
    itself; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, out = TaskContext.get().partitionId(), None, []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)
            out.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    mine = fingerprint(text)
                    if last is None:
                        out.append((doc_id, None, None, mine, None, None, None, part, "first", text))
                    else:
                        out.append((*compare(*last, text, mine), part, "row", None))
                    last = doc_id, text, mine
                if out:
                    yield flush()
        if last is not None:
            out.append((last[0], None, None, last[2], None, None, None, part, "last", last[1]))
            yield flush()

    done = settle(map_batches(dealt, run, ROW))
    firsts = done.where("kind = 'first'").select("part", F.col("text").alias("after"), F.col("fingerprint").alias("next_print"))
    follow = done.where("kind = 'first'").select("part")  # a row a range
    whole = Window.orderBy("part")
    follow = follow.select(F.col("part"), F.coalesce(F.lead("part").over(whole), F.min("part").over(whole)).alias("then"))
    ends = done.where("kind = 'last'").select("doc_id", "text", "fingerprint", "part").join(follow, "part").join(firsts.withColumnRenamed("part", "then"), "then")

    def finish(batch: pa.RecordBatch) -> dict:
        found = [compare(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)]
        return {c: pa.array([r[i] for r in found], _TYPES[i]) for i, c in enumerate(_NAMES[:7])}

    short = ", ".join(ROW.split(", ")[:7])
    finished = map_slices(ends.select("doc_id", "text", "fingerprint", "after", "next_print"), short, finish)
    return done.where("kind = 'row'").select(_NAMES[:7]).unionByName(finished)
