"""The best targets of each source, found a block of targets at a time; pairs never leave the task unless they are among the best there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sizes

#: Targets that are scored together.
BLOCK = 1024
#: Numbers in the matrix of the sources that goes to every task, 16 MB.
MATRIX = 1 << 21

PAIRS = "src string, trg string, score double"


class Best:
    """The ``keep`` best targets of each source among those added so far; ties beyond are cut by spelling."""

    def __init__(self, sources: int, keep: int, smaller: bool = False):
        self.keep, self.sign = keep, 1.0 if smaller else -1.0
        #: What a target's score, in rising order, must not exceed to get among the best.
        self.bar = np.full(sources, np.inf)
        self.src, self.cost, self.name = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.names = pa.array([], pa.string())
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.new = 0

    def add(self, names: pa.Array, src: np.ndarray, target: np.ndarray, score: np.ndarray) -> None:
        """Pairs of a block: numbers of sources, numbers among the block's names, scores."""
        cost = self.sign * score
        some = np.flatnonzero(cost <= self.bar[src])
        self.waiting.append((src[some], cost[some], target[some] + len(self.names)))
        self.names = pa.concat_arrays([self.names, names])
        self.new += len(some)
        if self.new > max(self.keep * len(self.bar), 1 << 16):
            self.cut()

    def cut(self) -> None:
        src, cost, name = (np.concatenate(x) for x in zip((self.src, self.cost, self.name), *self.waiting, strict=True))
        used, name = np.unique(name, return_inverse=True)
        names = self.names.take(pa.array(used, pa.int64()))
        order = pc.sort_indices(names).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows = np.lexsort((place[name], cost, src))
        src, cost, name = src[rows], cost[rows], name[rows]
        first = np.searchsorted(src, src)
        kept = np.arange(len(src)) - first < self.keep
        last = np.flatnonzero(np.arange(len(src)) - first == self.keep - 1)
        self.bar[src[last]] = cost[last]
        self.src, self.cost, self.name, self.names = src[kept], cost[kept], name[kept], names
        self.waiting, self.new = [], 0

    def rows(self, sources: list[str]) -> pa.RecordBatch:
        self.cut()
        columns = [pa.array(sources, pa.string()).take(pa.array(self.src, pa.int64())), self.names.take(pa.array(self.name, pa.int64())), pa.array(self.sign * self.cost + 0.0, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["src", "trg", "score"])


def each_task(targets: DataFrame, sources: list[str], keep: int, smaller: bool, score: Callable[[pa.RecordBatch, Best], None]) -> DataFrame:
    """(src, trg, score): the best of each task's targets, whose blocks ``score`` adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(sources), keep, smaller)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                score(batch.slice(at, BLOCK), best)
        yield best.rows(sources)

    return targets.mapInArrow(run, PAIRS)


class Vectors:
    """Sources as the rows of a matrix over the dimensions that they have."""

    def __init__(self, rows: list):
        self.names = [r.stem for r in rows]
        dims = sorted({d for r in rows for d in r.dims})
        number = {d: i for i, d in enumerate(dims)}
        self.dims = pa.array(dims, pa.string())
        self.own = np.zeros((len(rows), len(dims)))
        self.norm = np.zeros(len(rows))
        for i, r in enumerate(rows):
            self.own[i, [number[d] for d in r.dims]] = r.values
            self.norm[i] = np.dot(r.values, r.values)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b != 0)


#: Scores by products, squares of the target's weights on shared dimensions, and norms of either side.
SCORES = {
    "cosine": lambda dot, shared, n_src, n_trg: _ratio(dot, np.sqrt(n_src * n_trg)),
    "dice": lambda dot, shared, n_src, n_trg: _ratio(2 * dot, shared + n_src),
    "dice_cosine": lambda dot, shared, n_src, n_trg: _ratio(dot * dot, np.sqrt(n_src * shared) * (n_src + shared)),
    "product": lambda dot, shared, n_src, n_trg: dot,
}


def as_rows(vectors: DataFrame, side: str) -> DataFrame:
    """(stem, dims, values): a row a vector of (side, stem, dim, v)."""
    own = vectors.where(F.col("side") == side).groupBy("stem").agg(F.collect_list(F.struct(F.col("dim").cast("string").alias("dim"), F.col("v").cast("double").alias("v"))).alias("x"))
    return own.select("stem", F.col("x.dim").alias("dims"), F.col("x.v").alias("values"))


def source_matrix(vectors: DataFrame) -> Vectors | None:
    """The source vectors, if their matrix holds at most MATRIX numbers."""
    own = vectors.where("side = 'src'").persist()
    try:
        size = own.agg(F.countDistinct("stem").alias("n"), F.countDistinct("dim").alias("d")).first()
        return Vectors(sorted(as_rows(own, "src").collect(), key=lambda r: r.stem)) if size.n * size.d <= MATRIX else None
    finally:
        own.unpersist()


def best_products(vectors: DataFrame, sources: Vectors, keep: int, kind: str = "cosine", digits: int = 9) -> DataFrame:
    """(src, trg, score): of each source the best targets of every task among those of a score above 0, at most ``keep`` of each.

    vectors: (side, stem, dim, v) without negative values. A block of targets is scored against all sources as a matrix
    product. Scores are rounded, so that ties are ties whatever the order of summation.
    """

    def score(batch: pa.RecordBatch, best: Best) -> None:
        dims, values = batch.column(1), batch.column(2).flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), np.diff(dims.offsets.to_numpy()))
        norm = np.bincount(row, values * values, batch.num_rows)
        at = pc.fill_null(pc.index_in(dims.flatten(), sources.dims), -1).to_numpy(zero_copy_only=False)
        some = at >= 0
        block = np.zeros((batch.num_rows, len(sources.dims)))
        block[row[some], at[some]] = values[some]
        dot = block @ sources.own.T
        shared = (block * block) @ (sources.own != 0).T.astype(float) if kind.startswith("dice") else dot
        scores = np.round(SCORES[kind](dot, shared, sources.norm[None, :], norm[:, None]), digits)
        target, src = np.nonzero(scores > 0)
        best.add(batch.column(0), src, target, scores[target, src])

    return each_task(as_rows(vectors, "trg"), sources.names, keep, False, score)


#: Counters that a word's letters are dealt to.
LETTERS = 64


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, a row a word, 0 behind its end; and their lengths."""
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), max(size.max(initial=0), 1)), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, size


def letter_counts(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many letters of each word fall to each counter."""
    out = np.zeros((len(words), LETTERS), np.int16)
    row, at = np.nonzero(np.arange(words.shape[1]) < size[:, None])
    np.add.at(out, (row, words[row, at] % LETTERS), 1)
    return out


def edits(word: np.ndarray, others: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Levenshtein distance of a word (codes) from many, side by side."""
    width = others.shape[1]
    steps = np.arange(width + 1)
    row = np.tile(steps, (len(others), 1))
    for i, letter in enumerate(word, 1):
        best = np.minimum(row[:, 1:] + 1, row[:, :-1] + (others != letter))
        best = np.concatenate([np.full((len(others), 1), i), best], axis=1)
        row = np.minimum.accumulate(best - steps, axis=1) + steps  # an insertion costs 1 a place
    return row[np.arange(len(others)), size]


def nearest_words(sources: list[tuple[str, str]], targets: DataFrame, keep: int, counted=None) -> DataFrame:
    """(src, trg, score): of each source the targets of every task with the fewest edits, at most ``keep`` of each.

    sources: (name, spelling); targets: (stem, word), name and spelling. Two words differ by at least as many edits as letters
    that one has more of than the other; only pairs for which that is within what the last of the best so far takes
    are compared, the most promising first. ``counted``, an accumulator, adds up how many.
    """
    names = [n for n, _ in sources]
    own = [codes([w])[0][0][: len(w)] for _, w in sources]
    bags = letter_counts(*codes([w for _, w in sources]))
    lengths = np.array([len(w) for _, w in sources])

    def score(batch: pa.RecordBatch, best: Best) -> None:
        words, size = codes(batch.column(1).to_pylist())
        theirs = letter_counts(words, size)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s in range(len(names)):
            more = np.maximum(theirs - bags[s], 0).sum(axis=1)
            bound = np.maximum(more, more + lengths[s] - size)  # letters that only one of the two has
            order = np.argsort(bound, kind="stable")
            cost, bar, at = np.empty(0, np.int64), best.bar[s], 0
            while at < len(order) and bound[order[at]] <= bar:
                some = order[at : at + max(keep, 64)]
                some = some[bound[some] <= bar]
                done = edits(own[s], words[some], size[some])
                pairs.append((np.full(len(some), s), some, done.astype(float)))
                cost, at = np.concatenate([cost, done]), at + max(keep, 64)
                if len(cost) >= keep:
                    bar = min(bar, np.partition(cost, keep - 1)[keep - 1])
        if pairs:
            src, target, score = (np.concatenate(x) for x in zip(*pairs, strict=True))
            best.add(batch.column(0), src, target, score)
        if counted is not None:
            counted.add(len(src) if pairs else 0)

    return each_task(targets.select("stem", "word"), names, keep, True, score)


def few_sources(sources: DataFrame) -> list | None:
    """The rows, if they are at most FEW."""
    rows = sources.limit(sizes.FEW + 1).collect()
    return rows if len(rows) <= sizes.FEW else None
