"""Packing token sequences with a bounded number of open windows (operator 6)."""

from __future__ import annotations

import functools
import json
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, map_batches, settle

WINDOW, OPEN, END_ID = 2048, 64, 1
#: Partitions whose leftover windows are merged together; bounds a merging group to MERGE * OPEN windows.
MERGE = 16
#: Merged windows take their numbers from here on.
MERGED_BASE = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Encodes as the tokenizers library does with this byte-level file.

    Where merges are in the order of ids, the file's vocabulary serves as ranks for tiktoken, which gives the same ids
    four times as fast; otherwise the library itself encodes.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, added = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    ids = [vocab[a + b] for a, b in pairs]
    plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and ids == sorted(set(ids)) and not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
        import tiktoken

        of = byte_alphabet()
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in added}
        # The pattern of byte-level pre-tokenizers, a fixed value.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        return lambda text: fast.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_padding()
    slow.no_truncation()
    return lambda text: slow.encode(text, add_special_tokens=False).ids


class OpenWindows:
    """At most ``limit`` windows that still have room, kept in order of their room."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.made = size, limit, 0
        self.rooms: list[tuple[int, int]] = []  # (room, number), ascending

    def place(self, length: int) -> tuple[int, int]:
        """Best fit: the window with the least room that is enough. Gives (number, offset)."""
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.limit:
                self.rooms.pop(0)  # the fullest is emitted
            room, number = self.size, self.made
            self.made += 1
        if room > length:
            insort(self.rooms, (room - length, number))
        return number, self.size - room


PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, part long, window long, offset long, open boolean"


def place_pieces(df: DataFrame, tokenizer: str, window: int = WINDOW, limit: int = OPEN, end_id: int = END_ID) -> DataFrame:
    """Encodes each text, ends it with ``end_id``, cuts it at multiples of ``window`` and places the pieces.

    A row a piece; ``ids`` holds little-endian unsigned 32-bit ids. Windows are those of one partition; ``open`` marks
    pieces of windows that still had room at the partition's end. Only the rows since a window opened are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        windows = OpenWindows(window, limit)
        held: dict[int, list[tuple]] = {}  # pieces of windows that may still be open

        def emit(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            n = len(rows)
            arrays[5:5] = [pa.array([part] * n, pa.int64())]
            arrays.append(pa.array([is_open] * n, pa.bool_()))
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECE.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    for start in range(0, len(ids), window):
                        cut = ids[start : start + window]
                        number, offset = windows.place(len(cut))
                        held.setdefault(number, []).append((doc_id, start, len(cut), cut.tobytes(), len(ids), number, offset))
                live = {n for _, n in windows.rooms}
                done = [n for n in held if n not in live]
                if done:
                    yield emit([r for n in done for r in held.pop(n)], False)
        if held:
            yield emit([r for rows in held.values() for r in rows], True)

    return map_batches(df, run, PIECE)


def merge_leftovers(pieces: DataFrame, window: int = WINDOW, group: int = MERGE) -> DataFrame:
    """Numbers the sequences; windows left open are laid into one another, best fit, the longest first.

    Leftovers meet in groups of ``group`` partitions, at most ``group * open windows`` rows each. ``pieces`` is settled
    first: texts are encoded once.
    """
    pieces = settle(pieces)
    left = pieces.where("open").groupBy("part", "window").agg(F.max(F.col("offset") + F.col("length")).alias("fill"))

    def lay(pdf):
        pdf = pdf.sort_values(["fill", "part", "window"], ascending=[False, True, True])
        windows = OpenWindows(window, len(pdf))
        spots = [windows.place(int(n)) for n in pdf.fill]
        base = MERGED_BASE + (int(pdf.part.iloc[0]) // group << 32)
        return pdf[["part", "window"]].assign(merged=[base + n for n, _ in spots], shift=[o for _, o in spots])

    laid = left.groupBy(F.floor(F.col("part") / group)).applyInPandas(lay, "part long, window long, merged long, shift long")
    closed = pieces.where("not open").withColumn("sequence_id", F.shiftleft("part", 32) + F.col("window"))
    opened = pieces.where("open").join(laid, ["part", "window"]).withColumns({"sequence_id": F.col("merged"), "offset": F.col("offset") + F.col("shift")}).drop("merged", "shift")
    return closed.unionByName(opened).drop("part", "window", "open")


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, limit: int = OPEN, end_id: int = END_ID, derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Packs all documents into sequences of at most ``window`` ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``derive`` may replace the ids of pieces by what is computed from them, before pieces are written down.
    A null or empty text packs as its end id alone; a null id stays null; repeated rows are packed each; a long text is
    cut into full windows and a rest; an empty table gives no rows; other columns are ignored.
    """
    pieces = place_pieces(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer, window, limit, end_id)
    return merge_leftovers(derive(pieces) if derive else pieces, window)
