"""Listed phrases found in sentences through a trie of their tokens, a batch of sentences at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import splitting

#: Phrases whose trie goes to every task, a few megabytes; more are met by joins.
TRIE = 1 << 16
#: Sentences that are looked through together.
BATCH = 4096
#: More than a sentence has tokens.
WIDE = 1 << 31


class PhraseTrie:
    """Phrases (side, phrase) of white-space tokens. A state is a prefix; its children are found by a binary search.

    All places of a batch walk down together, a token a step, and those that left the trie drop out. So the work goes by the
    places whose tokens begin a listed phrase, and phrases of any length are found.
    """

    def __init__(self, listed: list[tuple[str, str]]):
        self.sides = sorted({side for side, _ in listed})
        tokens: dict[str, int] = {}
        children: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        self.phrases = sorted({phrase for _, phrase in listed if phrase})
        number = {p: i for i, p in enumerate(self.phrases)}
        for side, phrase in sorted(set(listed)):
            if not phrase:
                continue
            state = self.sides.index(side)
            for t in phrase.split(" "):
                key = (state, tokens.setdefault(t, len(tokens)))
                state = children.setdefault(key, len(self.sides) + len(children))
            ends[state] = number[phrase]
        self.tokens = list(tokens)
        keys = np.array([s * len(tokens) + t for s, t in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(children.values()), np.int64)[order]
        self.end = np.full(len(self.sides) + len(children), -1, np.int64)
        self.end[list(ends)] = list(ends.values())

    def child(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The state after a token, -1 where there is none."""
        key = state * len(self.tokens) + token
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((token >= 0) & (self.keys[at] == key), self.next[at], -1)

    def find(self, sides: pa.Array, toks: pa.ListArray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentence, position, length and phrase of each hit of up to ``longest`` tokens (below 0: any), by place and length."""
        bounds = toks.offsets.to_numpy().astype(np.int64)
        token = known_tokens(toks, self.tokens)
        sentence = np.repeat(np.arange(len(toks)), np.diff(bounds))
        last = np.repeat(bounds[1:] - bounds[0], np.diff(bounds))
        root = pc.fill_null(pc.index_in(sides, pa.array(self.sides, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.flatnonzero((token >= 0) & (root[sentence] >= 0)) if len(self.keys) else np.empty(0, np.int64)
        state, size, found = root[sentence[start]], 0, []
        while len(start) and size != longest:
            state = self.child(state, token[start + size])
            size += 1
            hit = np.flatnonzero((state >= 0) & (self.end[state] >= 0))
            found.append((start[hit], np.full(len(hit), size), self.end[state[hit]]))
            on = (state >= 0) & (start + size < last[start])
            start, state = start[on], state[on]
        at, n, phrase = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        order = np.lexsort((n, at))
        at, n, phrase = at[order], n[order], phrase[order]
        return sentence[at], at - (bounds[:-1] - bounds[0])[sentence[at]], n, phrase


def known_tokens(toks: pa.ListArray, some: list[str]) -> np.ndarray:
    """The number among ``some`` of each token of all sentences, -1 for others."""
    flat = toks.flatten()
    if pa.types.is_dictionary(flat.type):  # each distinct token is looked up once
        found = pc.index_in(flat.dictionary, pa.array(some, pa.string())).take(flat.indices)
    else:
        found = pc.index_in(flat, pa.array(some, pa.string()))
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def trie_of(listed: DataFrame) -> PhraseTrie | None:
    """The trie of (side, phrase) where there are at most TRIE rows."""
    rows = listed.select("side", "phrase").distinct().limit(TRIE + 1).collect()
    return PhraseTrie([(r.side, r.phrase) for r in rows]) if len(rows) <= TRIE else None


def by_batches(rows: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """What ``fn`` makes of sentences (toks), or of texts (phrase_text), which are split first."""
    names = rows.columns
    texts = "toks" not in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in splitting.sentences(batches, names) if texts else batches:
            if texts:  # slices of bounded bytes already
                yield fn(batch)
                continue
            for at in range(0, batch.num_rows, BATCH):
                yield fn(batch.slice(at, BATCH))

    return rows.mapInArrow(run, schema)


HIT = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("n_tok", T.IntegerType()), T.StructField("phrase", T.StringType())]))


def with_hits(rows: DataFrame, trie: PhraseTrie, longest: int) -> DataFrame:
    """The rows (with side and toks) in which listed phrases occur, each with its ``hits``; nothing is shuffled."""
    schema = T.StructType([*rows.schema.fields, T.StructField("hits", HIT)])
    side, toks = rows.columns.index("side"), rows.columns.index("toks")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sentence, pos, n, phrase = trie.find(batch.column(side), batch.column(toks), longest)
        some, counts = np.unique(sentence, return_counts=True)
        text = pa.array(trie.phrases, pa.string()).take(pa.array(phrase))
        hits = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(n, pa.int32()), text], ["pos", "n_tok", "phrase"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), hits)
        kept = batch.take(pa.array(some))
        return pa.RecordBatch.from_arrays([*kept.columns, lists], schema.names)

    return by_batches(rows, run, schema)


def open_hits(found: DataFrame, *carried: str) -> DataFrame:
    """A row a hit: the carried columns, pos, n_tok, phrase."""
    return found.select(*carried, F.explode("hits").alias("h")).select(*carried, "h.pos", "h.n_tok", "h.phrase")


def hit_counts(rows: DataFrame, trie: PhraseTrie, longest: int, *keys: str) -> DataFrame:
    """(keys, phrase, n_tok, n): how often each listed phrase occurs under each key. rows: side, keys, and toks or phrase_text."""
    names = rows.columns
    side, toks = names.index("side"), splitting.column(names)
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("phrase", T.StringType()), T.StructField("n_tok", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sentence, _, n, phrase = trie.find(batch.column(side), batch.column(toks), longest)
        hits = pa.table([*(batch.column(names.index(k)).take(pa.array(sentence)) for k in keys), pa.array(phrase), pa.array(n, pa.int32())], [*keys, "at", "n_tok"])
        counted = hits.group_by([*keys, "at", "n_tok"]).aggregate([([], "count_all")]).combine_chunks()
        text = pa.array(trie.phrases, pa.string()).take(counted.column("at").combine_chunks())
        columns = [*(counted.column(k).combine_chunks() for k in keys), text, counted.column("n_tok").combine_chunks(), counted.column("count_all").combine_chunks()]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return by_batches(rows, run, schema).groupBy(*keys, "phrase", "n_tok").agg(F.sum("n").alias("n"))


def near_words(rows: DataFrame, trie: PhraseTrie, longest: int, words: list[tuple[str, str]], left: int, right: int) -> DataFrame:
    """(side, stem, ctx, ctx_n): how often a listed word (side, word) is among the ``left`` nearest words that end before a
    listed phrase, or the ``right`` nearest that start after it. rows: side, and toks or phrase_text.

    Each distinct token is split into its words once; what stands around a hit is then looked up by number.
    """
    side, toks = rows.columns.index("side"), splitting.column(rows.columns)
    listed = sorted({w for _, w in words})
    known = np.zeros((len(trie.sides), len(listed) + 1), bool)  # the last: any other word
    for s, w in words:
        if s in trie.sides:
            known[trie.sides.index(s), listed.index(w)] = True

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sents = batch.column(toks)
        sentence, pos, n, phrase = trie.find(batch.column(side), sents, longest)
        tokens = sents.flatten().dictionary_encode()
        row, inner = splitting.word_sentences(tokens.dictionary, small=False)
        sizes = np.diff(inner.offsets.to_numpy())
        number = known_tokens(inner, listed)  # of the words of all distinct tokens, one token after another
        count = np.bincount(row, sizes, len(tokens.dictionary)).astype(np.int64)
        first = np.cumsum(count) - count
        token = tokens.indices.to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(count[token])])  # words before each token
        which = np.repeat(first[token] - ends[:-1], count[token]) + np.arange(ends[-1])
        word = number[which]
        bounds = sents.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        at = bounds[sentence] + pos
        own = pc.index_in(batch.column(side), pa.array(trie.sides, pa.string())).to_numpy(zero_copy_only=False)[sentence].astype(np.int64)
        keys = []
        for place, inside in [(ends[at] - k, lambda p: p >= ends[bounds[sentence]]) for k in range(1, left + 1)] + [(ends[at + n] + k, lambda p: p < ends[bounds[sentence + 1]]) for k in range(right)]:
            hit = np.flatnonzero(inside(place))
            hit = hit[known[own[hit], word[place[hit]]]]
            keys.append((own[hit] * max(len(trie.phrases), 1) + phrase[hit]) * max(len(listed), 1) + word[place[hit]])
        pair, counts = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
        pair, ctx = np.divmod(pair, max(len(listed), 1))
        s, stem = np.divmod(pair, max(len(trie.phrases), 1))
        columns = [pa.array(x, pa.string()).take(pa.array(i)) for x, i in ((trie.sides, s), (trie.phrases, stem), (listed, ctx))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], ["side", "stem", "ctx", "n"])

    counted = by_batches(rows, run, "side string, stem string, ctx string, n long")
    return counted.groupBy("side", "stem", "ctx").agg(F.sum("n").cast("double").alias("ctx_n"))


def neighbour_counts(rows: DataFrame, trie: PhraseTrie, longest: int, gap: int, longest_only: bool) -> DataFrame:
    """(side, phrase, rel, ctx_phrase, n): neighbours of listed phrases, met inside each sentence and counted a batch at a time.

    rows: side, toks, gaps (widths of the white space after each token). Hits are looked up by where they end and start; see
    reorder.neighbours for which neighbour counts.
    """
    side, toks, gaps = (rows.columns.index(c) for c in ("side", "toks", "gaps"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sentence, pos, n, phrase = trie.find(batch.column(side), batch.column(toks), longest)
        met = sweep(sentence, pos, n, phrase, widths(batch.column(gaps), sentence, pos - 1), widths(batch.column(gaps), sentence, pos + n - 1), gap, longest_only)
        sides = pc.index_in(batch.column(side), pa.array(trie.sides, pa.string())).to_numpy(zero_copy_only=False)
        own, rel, other = (np.concatenate(x) for x in zip(*met, strict=True))
        near = np.array([s == "trg" for s in trie.sides], bool)
        kept = (rel != 2) | near[sides[sentence[own]].astype(np.int64)]
        own, rel, other = own[kept], rel[kept], other[kept]
        size = len(trie.phrases)
        key, counts = np.unique(((sides[sentence[own]].astype(np.int64) * 3 + rel) * size + phrase[own]) * size + phrase[other], return_counts=True)
        names = pa.array(trie.phrases, pa.string())
        key, ctx = np.divmod(key, size)
        key, own = np.divmod(key, size)
        s, rel = np.divmod(key, 3)
        columns = [pa.array(trie.sides, pa.string()).take(pa.array(s)), names.take(pa.array(own)), pa.array(["before", "after", "disc"]).take(pa.array(rel)), names.take(pa.array(ctx)), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["side", "phrase", "rel", "ctx_phrase", "n"])

    counted = by_batches(rows, run, "side string, phrase string, rel string, ctx_phrase string, n long")
    return counted.groupBy("side", "phrase", "rel", "ctx_phrase").agg(F.sum("n").alias("n"))


def widths(gaps: pa.ListArray, sentence: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The width of a sentence's gap number ``at``, 0 where it has none."""
    bounds = gaps.offsets.to_numpy().astype(np.int64)
    values = np.append(gaps.flatten().to_numpy(zero_copy_only=False), 0)
    place = bounds[sentence] - bounds[0] + at
    return values[np.where((at >= 0) & (place < bounds[sentence + 1] - bounds[0]), place, -1)]


def sweep(sentence, pos, n, phrase, gap_before, gap_after, gap: int, longest_only: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hit, relation, neighbouring hit), 0 before, 1 after, 2 near: at most one neighbour of each hit and relation.

    For each gap a hit looks up the hits that end as far before it and those that start as far behind it. Of several the
    longest counts, then the first (or, unless ``longest_only``, the last and of those the longest).
    """
    hits = np.arange(len(pos))
    weight = n * WIDE - pos if longest_only else pos * WIDE + n
    tables = []
    for place in (pos + n, pos):
        key = sentence * WIDE + place
        order = np.lexsort((weight, key))
        last = np.append(np.flatnonzero(np.diff(key[order])), len(order) - 1) if len(order) else order
        tables.append((key[order][last], order[last]))  # the best hit of each place

    def look(table: tuple[np.ndarray, np.ndarray], place: np.ndarray) -> np.ndarray:
        keys, best = table
        if not len(keys):
            return np.full(len(place), -1)
        key = sentence * WIDE + place
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((place >= 0) & (keys[at] == key), best[at], -1)

    near, out = np.full(len(pos), -1), []
    for g in range(gap + 1):
        for rel, table, place, width in ((0, tables[0], pos - g, gap_before), (1, tables[1], pos + n + g, gap_after)):
            other = look(table, place)
            adjacent = (other >= 0) & (width == 1) if g == 0 else np.zeros(len(pos), bool)
            out.append((hits[adjacent], np.full(adjacent.sum(), rel), other[adjacent]))
            other = np.where(adjacent, -1, other)
            better = (other >= 0) & ((near < 0) | (weight[other] > weight[near]))
            near = np.where(better, other, near)
    out.append((hits[near >= 0], np.full((near >= 0).sum(), 2), near[near >= 0]))
    return out


def word_spans(rows: DataFrame, words: list[str], longest: int) -> DataFrame:
    """(phrase, n_tok, n): all n-grams that hold none but the given words, counted a batch at a time. rows: toks or phrase_text."""
    toks = splitting.column(rows.columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sents = batch.column(toks)
        token = known_tokens(sents, words)
        bounds = sents.offsets.to_numpy().astype(np.int64)
        last = np.repeat(bounds[1:] - bounds[0], np.diff(bounds))
        start, code, names = np.flatnonzero(token >= 0), None, []
        columns: list[list] = [[], [], []]
        for size in range(1, longest + 1):
            if size > 1:
                on = (start + size <= last[start]) & (token[np.minimum(start + size - 1, len(token) - 1)] >= 0)
                start, code = start[on], code[on]
            code = token[start] if size == 1 else code * len(words) + token[start + size - 1]
            some, code, counts = np.unique(code, return_inverse=True, return_counts=True)  # n-grams are numbered anew at each size
            names = [words[c] for c in some] if size == 1 else [f"{names[p]} {words[c]}" for p, c in zip(*(x.tolist() for x in np.divmod(some, len(words))), strict=True)]
            columns[0] += names
            columns[1] += [size] * len(names)
            columns[2] += counts.tolist()
        types = [pa.string(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["phrase", "n_tok", "n"])

    return by_batches(rows, run, "phrase string, n_tok int, n long").groupBy("phrase", "n_tok").agg(F.sum("n").alias("n"))


def ngram_counts(rows: DataFrame, longest: int) -> DataFrame:
    """(side, phrase, n_tok, n): all n-grams of up to ``longest`` tokens of the sentences (side, toks), counted a batch at a
    time by numbers; only what is distinct in a batch is put together as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks, side = batch.column(1), batch.column(0).dictionary_encode(null_encoding="encode")
            words = toks.flatten().dictionary_encode()
            word = words.indices.to_numpy().astype(np.int64)
            bounds = toks.offsets.to_numpy().astype(np.int64) - toks.offsets[0].as_py()
            last = np.repeat(bounds[1:], np.diff(bounds))
            start = np.arange(len(word))
            sides = max(len(side.dictionary), 1)
            code = np.repeat(side.indices.to_numpy().astype(np.int64), np.diff(bounds))  # the side, then the n-gram so far
            own, names, width = np.arange(sides), None, max(len(words.dictionary), 1)
            for size in range(1, longest + 1):
                on = start + size <= last[start]
                start = start[on]
                if not len(start):
                    break
                some, code, counts = np.unique(code[on] * width + word[start + size - 1], return_inverse=True, return_counts=True)
                before, token = np.divmod(some, width)
                text = words.dictionary.take(pa.array(token))
                names = text if names is None else pc.binary_join_element_wise(names.take(pa.array(before)), text, " ")
                own = own[before]
                columns = [side.dictionary.take(pa.array(own)), names, pa.array(np.full(len(some), size, np.int32)), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["side", "phrase", "n_tok", "n"])

    counted = rows.select("side", "toks").mapInArrow(run, "side string, phrase string, n_tok int, n long")
    return counted.groupBy("side", "phrase", "n_tok").agg(F.sum("n").alias("n"))
