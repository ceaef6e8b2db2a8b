"""Exact BPE by backtracking over Aho-Corasick matches, and decoding by offsets (operator 10)."""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices
from .packing import byte_alphabet

WORD_END = "</w>"
#: White space as Unicode defines it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words whose ids a worker keeps.
CACHE = 400_000
#: Stand-ins for a word's last symbol lie this far above the symbol.
LAST = 0x1000


class WordBpe:
    """BPE with word ends, read from a file of the tokenizers library.

    A word is a string of byte symbols whose last one is moved up by LAST, so that each symbol is one character.
    The automaton gives the longest token from each place; a token may follow another only if BPE would leave the two
    apart, which the pair table, filled as pairs come up, answers by undoing merges along the border.
    """

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["end_of_word_suffix"] != WORD_END or [x["type"] for x in splits] != ["Split", "ByteLevel"]:
            raise ValueError("not a lower-casing BPE file with word ends")
        vocab = spec["model"]["vocab"]
        self.words = regex.compile(splits[0]["pattern"]["Regex"].replace("\\s", SPACE))
        self.space = regex.compile(f"[{SPACE}]+")
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.symbol = {b: c for c, b in byte_alphabet().items()}
        self.upper = [self.symbol[b] for b in range(256)]

        n = max([*vocab.values(), *self.added.values()]) + 1
        self.rank, self.left, self.right = [-1] * n, [0] * n, [0] * n
        self.key: list[str | None] = [None] * n
        for c in self.upper:
            if c in vocab:
                self.key[vocab[c]] = c
            if c + WORD_END in vocab:
                self.key[vocab[c + WORD_END]] = chr(ord(c) + LAST)
        self.joined: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            t = vocab[a + b]
            a, b = vocab[a], vocab[b]
            self.joined[a, b] = rank
            if self.key[t] is None:
                self.rank[t], self.left[t], self.right[t] = rank, a, b
                self.key[t] = self.key[a] + self.key[b]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        reached = [False] * n
        for t in sorted((t for t in range(n) if self.key[t] is not None), key=lambda t: self.rank[t]):
            base = self.rank[t] < 0
            reached[t] = base or reached[self.left[t]] and reached[self.right[t]] and self.apart(self.left[t], self.right[t], self.rank[t])
            if reached[t]:
                self.whole[self.key[t]] = t
                self.automaton.add_word(self.key[t], t)
        self.automaton.make_automaton()
        self.length = [len(k or "") for k in self.key]
        self.cache: dict[str, bytes] = {}
        # Offsets into one buffer of all tokens' text, each followed by the blank that stands between tokens.
        text = {i: t.encode() for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        spans = [text.get(i, b"") + b" " for i in range(n)]
        self.offset = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
        self.buffer = np.frombuffer(b"".join(spans), np.uint8)

    def apart(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether BPE leaves a and b beside each other, merges from ``limit`` on not counted."""
        rank, joined = self.rank, self.joined
        while True:
            across = joined.get((a, b))
            if across is not None and across < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:  # the later merge is undone; of equal ones the left one came first
                limit, a = rank[a], self.right[a]
            else:
                limit, b = rank[b] + 1, self.left[b]

    def follows(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 4 * CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.apart(a, b)
        return known

    def encode_symbols(self, word: str) -> list[int]:
        """Tries at each place the longest token first; places that led nowhere are not tried again."""
        if (t := self.whole.get(word)) is not None:
            return [t]
        n = len(word)
        longest: list[list[int]] = [[] for _ in range(n)]
        length, follows = self.length, self.follows
        for end, t in self.automaton.iter(word):
            longest[end + 1 - length[t]].append(t)  # ends grow, so the last is the longest
        dead = [False] * (n + 1)
        out: list[int] = []
        tries = [len(longest[0])]
        pos = 0
        while pos < n:
            options, k = longest[pos], tries[-1] - 1
            while k >= 0 and (dead[pos + length[options[k]]] or out and not follows(out[-1], options[k])):
                k -= 1
            if k >= 0:
                tries[-1] = k
                out.append(options[k])
                pos += length[options[k]]
                tries.append(len(longest[pos]) if pos < n else 0)
            else:
                if not out:
                    raise ValueError(f"no tokens for {word!r}")
                dead[pos] = True
                tries.pop()
                pos -= length[out.pop()]
        return out

    def encode_word(self, word: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a pre-token."""
        symbols = [self.upper[b] for b in word.encode("utf-8", "replace")]
        symbols[-1] = chr(ord(symbols[-1]) + LAST)
        ids = np.array(self.encode_symbols("".join(symbols)), "<u4").tobytes()
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = ids
        return ids

    def normalize(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return self.space.sub(" ", text).replace("Σ", "σ").lower()  # no final sigma: each character is lowered alone

    def encode_plain(self, text: str, out: list[bytes]) -> None:
        known, encode = self.cache.get, self.encode_word
        for word in self.words.findall(self.normalize(text)):
            out.append(known(word) or encode(word))

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        if self.special is None or not self.special.search(text):
            self.encode_plain(text, out)
        else:
            for part in self.special.split(text):
                if part in self.added:
                    out.append(np.uint32(self.added[part]).tobytes())
                elif part:
                    self.encode_plain(part, out)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens with blanks between them, gathered through the offset table."""
        if not len(ids):
            return b""
        starts = self.offset[ids]
        sizes = self.offset[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.buffer[at].tobytes()[:-1]


@functools.lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_texts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit).

    Texts of any length are encoded whole, in time that grows with them. A null text counts as empty and has no ids; null ids stay null; repeated rows give a row each; an empty table gives
    no rows; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> dict:
        bpe = word_bpe(tokenizer)
        ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary())}

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(rows, "doc_id long, n_tokens long, ids binary", run)


def decode_ids(df: DataFrame, tokenizer: str) -> DataFrame:
    """Text of every row's ids, beside doc_id, n_tokens and ids; null ids decode as no ids."""

    def run(batch: pa.RecordBatch) -> dict:
        bpe = word_bpe(tokenizer)
        texts = [bpe.decode(np.frombuffer(x or b"", "<u4")).decode() for x in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "n_tokens": batch.column(1), "ids": batch.column(2), "decoded": pa.array(texts, pa.string())}

    return map_slices(df.select("doc_id", "n_tokens", "ids"), "doc_id long, n_tokens long, ids binary, decoded string", run)
