"""Texts split into sentences of words or tokens, some megabytes of bytes at a time; the result is that of functions/text.py.

Column functions split a line by regular expressions and make each word a string. Here delimiters are looked up by byte, words
lie between them, and a word becomes a string once a slice, so that steps that only count go through texts several times
faster. Columns of lists of tokens pass as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split together; a longer text is split alone.
SLICE = 1 << 22

INSIDE, BETWEEN, END, LINE = 0, 1, 2, 3
_SPACES = " \t\n\x0b\f\r"


def _kinds(between: str, ends: str) -> tuple[np.ndarray, dict[int, list[tuple[bytes, int]]]]:
    """The kind of each byte, and by first byte the further ones and kind of delimiters of several bytes."""
    table, longer = np.zeros(256, np.uint8), {}
    for chars, kind in ((between, BETWEEN), (ends, END), ("\n", LINE)):
        for c in chars:
            code = c.encode()
            if len(code) == 1:
                table[code[0]] = kind
            else:
                longer.setdefault(code[0], []).append((code[1:], kind))
    return table, longer


_WORD = _kinds(_SPACES + "$*\"'-+=,;:«»{}()<>[]–“”‘’\u00a0", "|.?¿!¡")
_PHRASE = _kinds(_SPACES, ".?¿!¡")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Capitals that Spark's lower() knows and this Python's does not yet. Right behind such a letter a final capital sigma stays σ.
_NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 32 for c in range(0x10D50, 0x10D66)}
_NEW = re.compile("[" + "".join(map(chr, _NEWER)) + "]")


def lower(words: pa.Array) -> pa.Array:
    """Words, whose ASCII letters are small already and which hold no line break, in lower case."""
    odd = np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))
    if not len(odd):
        return words
    text = "\n".join(words.take(pa.array(odd)).to_pylist())
    small = (text.translate(_NEWER) if _NEW.search(text) else text).lower().split("\n")
    place = np.arange(len(words))
    place[odd] = len(words) + np.arange(len(odd))
    return pa.concat_arrays([words, pa.array(small, pa.string())]).take(pa.array(place))


def _split(texts: pa.Array, kinds: tuple, attached: bool, small: bool) -> tuple[np.ndarray, pa.ListArray]:
    """The text and the words of each sentence that has any. attached: ends of sentences belong to the word before them."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    table, longer = kinds
    kind = table[data]
    for first, rest in longer.items():
        at = np.flatnonzero(data == first)
        for code, k in rest:
            hit = at
            for i, byte in enumerate(code, 1):
                hit = hit[data[hit + i] == byte]
            for i in range(len(code) + 1):
                kind[hit + i] = k
    inside = (kind == INSIDE) | (kind == END) if attached else kind == INSIDE
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    if attached:  # behind its ends a new sentence begins, with or without a space
        end = kind == END
        turn = np.flatnonzero(end[:-1] & ~end[1:]) + 1
        start[turn] = inside[turn]
        stop[turn - 1] = True
        cut = np.union1d(turn, np.flatnonzero(kind == LINE))
    else:
        cut = np.flatnonzero(kind >= END)
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    start[edge], stop[edge - 1] = inside[edge], inside[edge - 1]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    row = np.searchsorted(bounds[1:], start, "right")
    sentence = row + np.searchsorted(cut, start, "right")
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer((_LOWER[data] if small else data)[inside])).dictionary_encode()
    if small:
        names = lower(words.dictionary).dictionary_encode()
        words = pa.DictionaryArray.from_arrays(names.indices.take(words.indices), names.dictionary)
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    return row[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(start)), pa.int32()), words)


def word_sentences(texts: pa.Array, small: bool = True) -> tuple[np.ndarray, pa.ListArray]:
    """As sentences() and words(), without empty words, which only begin a sentence."""
    return _split(texts, _WORD, False, small)


def phrase_sentences(texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """As phrase_sentences() and tokens(), lower-cased."""
    return _split(texts, _PHRASE, True, True)


#: Columns of texts that are split when they are read, by name.
SPLITS = {"text": word_sentences, "phrase_text": phrase_sentences}


def column(names: list[str]) -> int:
    """The place of the words: a column toks of lists, or of texts to split."""
    return next(names.index(c) for c in ("toks", *SPLITS) if c in names)


def sentences(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches whose texts are split, a row a sentence, with the other columns kept."""
    at = column(names)
    split = SPLITS.get(names[at])
    for batch in batches:
        if split is None:
            yield batch
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = size[begin - 1] if begin else 0
            upto = max(int(np.searchsorted(size, done + SLICE, "right")), begin + 1)
            part = batch.slice(begin, upto - begin)
            row, toks = split(part.column(at))
            kept = part.select([i for i in range(len(names)) if i != at]).take(pa.array(row)).columns
            yield pa.RecordBatch.from_arrays([*kept[:at], toks, *kept[at:]], [*names[:at], "toks", *names[at + 1 :]])
            begin = upto
