"""Piece BPE over a table of distinct chunks, and decoding by offsets (operator 13)."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_slices

MARK = "▁"
#: Characters of chunks that a worker keeps segmented, and the longest chunk that it keeps.
KEPT, LONGEST = 6_000_000, 64
#: Bytes of text that are encoded together.
BYTES = 1 << 22
#: The rank of a pair that makes no piece.
NO_PIECE = 1 << 30


def gather(buffer: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``which`` of a ragged table one after another, and the places where each ends."""
    starts = offsets[which]
    sizes = offsets[which + 1] - starts
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return buffer[at], ends


class PieceBpe:
    """BPE by piece scores with byte fallback, read from a model file of the sentencepiece library.

    White space is a marker at the start of a word. As no piece holds a marker after another character, no merge crosses
    the start of a run of markers: a text falls into chunks of markers and what follows them, each segmented for itself.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train, kind = spec.normalizer_spec, spec.trainer_spec, spec.SentencePiece
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or train.treat_whitespace_as_suffix:
            raise ValueError("only models that mark white space before words and normalise nothing else are read")
        if train.model_type != 2 or not train.byte_fallback or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in spec.pieces):
            raise ValueError("only BPE models with byte fallback and without pieces of the user are read")
        self.score = {p.piece: p.score for p in spec.pieces if p.type == kind.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
        self.byte = [0] * 256
        self.is_byte = np.zeros(len(spec.pieces), bool)
        self.is_control = np.zeros(len(spec.pieces), bool)
        self.is_marked = np.array([p.piece.startswith(MARK) and p.type == kind.NORMAL for p in spec.pieces])
        surfaces = []
        for i, p in enumerate(spec.pieces):
            if p.type == kind.BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                self.is_byte[i] = True
                surfaces.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kind.CONTROL:
                self.is_control[i] = True
                surfaces.append(b"")
            else:
                surfaces.append((train.unk_surface if p.type == kind.UNKNOWN else p.piece.replace(MARK, " ")).encode())
        self.offset = np.concatenate([[0], np.cumsum([len(s) for s in surfaces])])
        self.buffer = np.frombuffer(b"".join(surfaces), np.uint8)
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.id)
        ranks = {s: i for i, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        made = sorted((self.id[p[:k]] * len(self.offset) + self.id[p[k:]], ranks[s], self.id[p]) for p, s in self.score.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id)
        self.pairs, self.pair_rank, self.pair_piece = (np.array(x, np.int64) for x in zip(*made, strict=True))
        self.known: dict[str, bytes] = {}
        self.held = 0

    def segment(self, chunks: list[str]) -> list[bytes]:
        """Ids (32-bit) of each chunk: the neighbours of the best score merge, the leftmost first, until no two make a piece.

        Chunks of up to LONGEST characters go side by side through arrays, one merge a chunk and round.
        """
        out = [b""] * len(chunks)
        short = [i for i, c in enumerate(chunks) if len(c) <= LONGEST]
        if short:
            flat, ends = self.merge_rounds([chunks[i] for i in short])
            starts = np.concatenate([[0], ends[:-1]])
            raw, lost = flat.astype(np.int32).tobytes(), np.minimum.reduceat(flat, starts) < 0
            for i, x, y in zip(short, (4 * starts).tolist(), (4 * ends).tolist(), strict=True):
                out[i] = raw[x:y]
            for k in np.flatnonzero(lost):
                out[short[k]] = self.packed(self.spelt(chr(~t)) if t < 0 else [t] for t in flat[starts[k] : ends[k]].tolist())
        for i, chunk in enumerate(chunks):
            if len(chunk) > LONGEST:
                out[i] = self.packed([self.id[p]] if p in self.id else self.spelt(p) for p in self.merged_long(chunk))
        return out

    def packed(self, ids: Iterable[list[int]]) -> bytes:
        return np.fromiter(chain.from_iterable(ids), np.int32).tobytes()

    def spelt(self, text: str) -> list[int]:
        return [self.byte[b] for b in text.encode()]

    def merge_rounds(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all chunks one after another (a character without a piece: the complement of its code), and where each ends."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.int32)
        letters, which = np.unique(codes, return_inverse=True)
        sym = np.array([self.id.get(chr(c), ~int(c)) for c in letters], np.int64)[which]
        owner = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, joined = self.pair(sym, owner, np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank * len(sym) + np.arange(len(sym)), starts)
            open_, place = best < NO_PIECE * len(sym), best % len(sym)
            live = np.repeat(open_, np.diff(starts, append=len(sym)))
            done.append((owner[~live], sym[~live]))
            place = place[open_]
            sym[place] = joined[place]
            live[place + 1] = False
            keep = np.flatnonzero(live)
            place = np.searchsorted(keep, place)
            sym, owner, rank, joined = sym[keep], owner[keep], rank[keep], joined[keep]
            near = np.concatenate([place, np.maximum(place - 1, 0)])
            if len(near):
                rank[near], joined[near] = self.pair(sym, owner, near)
        owner, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return sym[order], np.cumsum(np.bincount(owner, minlength=len(chunks)))

    def pair(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of what each symbol makes with the next one of its chunk."""
        after = np.minimum(at + 1, len(sym) - 1)
        left, right = sym[at], sym[after]
        key = np.where((owner[at] == owner[after]) & (after > at) & (left >= 0) & (right >= 0), left * len(self.offset) + right, -1)
        found = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[found] == key
        return np.where(hit, self.pair_rank[found], NO_PIECE), self.pair_piece[found]

    def merged_long(self, chunk: str) -> list[str]:
        """The same with a heap of neighbours, in time that grows hardly faster than the chunk."""
        parts: list[str | None] = list(chunk)
        score, n = self.score, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, 2) for i in range(n - 1) if (s := score.get(chunk[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) == n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has merged since
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (-s, i, size + len(parts[k])))
            if (h := before[i]) >= 0 and (s := score.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (-s, h, len(parts[h]) + size))
        return [p for p in parts if p is not None]

    def table(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks; those not known yet are segmented together."""
        if self.held > KEPT:
            self.known.clear()
            self.held = 0
        out = list(map(self.known.get, chunks))
        new = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(new, self.segment([chunks[i] for i in new]), strict=True):
            out[i] = ids
            if len(c := chunks[i]) <= LONGEST:
                self.known[c] = ids
                self.held += len(c)
        return out

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts one after another, and how many each text has."""
        marked = pc.replace_substring(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))), " ", MARK)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(marked).to_numpy(zero_copy_only=False))]).astype(np.int64)
        data = np.frombuffer(b"".join(x.as_buffer() for x in marked if x.as_buffer().size), np.uint8)
        if self.splits and len(data):
            a, b, c = MARK.encode()
            is_mark = np.zeros(len(data) + 3, bool)
            is_mark[3 : len(data) + 1] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
            starts = is_mark[3:] & ~is_mark[:-3]  # a marker that no marker comes right before
            starts[ends[:-1][np.diff(ends) > 0]] = True
            starts = np.flatnonzero(starts)
        else:
            starts = ends[:-1][np.diff(ends) > 0]
        offsets = np.concatenate([starts, [len(data)]]).astype(np.int64)
        rows = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
        return rows, np.diff(np.searchsorted(starts, ends))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids end. Each distinct chunk is segmented once."""
        chunks, counts = self.chunks(pc.fill_null(texts, "").cast(pa.large_string()))
        table = chunks.dictionary_encode()
        pieces = self.table(table.dictionary.to_pylist())
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64) // 4
        flat = np.frombuffer(b"".join(pieces), np.int32)
        ids, ends = gather(flat, offsets, table.indices.to_numpy().astype(np.int64))
        return ids, np.concatenate([[0], ends]).astype(np.int64)[np.cumsum(counts)]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the pieces; the first one's marker goes, and bytes that are no UTF-8 become U+FFFD each."""
        first = np.flatnonzero(~self.is_control[ids])[:1]
        skip = int(len(first) and self.is_marked[ids[first[0]]])
        if self.is_byte[ids].any():
            # Only bytes side by side make a character, so each run of them is read for itself.
            runs = np.split(ids, np.flatnonzero(np.diff(self.is_byte[ids])) + 1)
            return b"".join(valid_utf8(d) if self.is_byte[r[0]] else d for r in runs for d in [self.surface(r)])[skip:]
        return self.surface(ids)[skip:]

    def surface(self, ids: np.ndarray) -> bytes:
        return gather(self.buffer, self.offset, ids.astype(np.int64))[0].tobytes()


def valid_utf8(data: bytes) -> bytes:
    """Each byte that begins no character of UTF-8 becomes U+FFFD."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode().encode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


@functools.lru_cache(2)
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def lists(flat: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values one after another and where each row's end."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat, kind))


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have at most ``most`` bytes together, or a single text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, schema: str, most: int, fn: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """mapInArrow over (doc_id, text) in slices of at most ``most`` bytes of text, which bounds what a worker holds."""
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in by_bytes(batch, 1, most):
                out = fn(piece)
                yield pa.RecordBatch.from_pydict({c: out[c] for c in columns})

    return map_batches(df, run, schema)


def encode_texts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, without begin or end: doc_id, n_tokens, ids (array of int).

    The chunks of a slice of rows form one table of distinct chunks; each is segmented once, those of up to LONGEST
    characters once for many slices, and their ids are joined back by the chunks' positions. Nothing is shuffled. Where
    pieces can cross markers, texts are their own chunks. Null and empty texts have no ids; texts of any length are
    encoded whole; null ids stay null; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> dict:
        ids, ends = piece_bpe(model).encode_all(batch.column(1))
        return {"doc_id": batch.column(0), "n_tokens": pa.array(np.diff(ends, prepend=0), pa.int64()), "ids": lists(ids, ends, pa.int32())}

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, "doc_id long, n_tokens long, ids array<int>", BYTES, run)


def decode_ids(df: DataFrame, model: str) -> DataFrame:
    """Text of every row's ids, beside doc_id, n_tokens and ids; null ids decode as no ids."""

    def run(batch: pa.RecordBatch) -> dict:
        bpe, rows = piece_bpe(model), batch.column(2)
        texts = [bpe.decode(x.values.to_numpy() if x.is_valid else np.empty(0, np.int32)).decode() for x in rows]
        return {"doc_id": batch.column(0), "n_tokens": batch.column(1), "ids": rows, "decoded": pa.array(texts, pa.string())}

    return map_slices(df.select("doc_id", "n_tokens", "ids"), "doc_id long, n_tokens long, ids array<int>, decoded string", run)
