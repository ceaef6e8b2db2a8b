"""Near-duplicate vectors through a robust-pruned flat graph (operator 7)."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, settle
from .components import components

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    """shard: vectors of a cluster shard, about; most: vectors of a shard beyond which it is split again. block: those of
    a block where all pairs are compared. overlap: shards of a vector. near: candidates of a node from its own batch; far: those
    drawn at random; degree, alpha: what robust pruning leaves; medoids: where searches start; beam: width of the greedy search; batch: nodes that enter
    the graph, and queries that run, together; slack: how far below the threshold the search still expands; audit: queries
    of the recall audit; goal: recall that ends it; widest: overlap, in multiples of the first, after which all pairs are
    compared instead; clusters: most centroids that one k-means makes, levels: most times that shards are split, sample:
    vectors a centroid that k-means looks at, about, which bounds what the driver or a task holds."""

    shard: int = 1500
    most: int = 4000
    block: int = 2000
    overlap: int = 3
    near: int = 8
    far: int = 8
    degree: int = 20
    alpha: float = 1.2
    medoids: int = 24
    beam: int = 24
    batch: int = 256
    slack: float = 0.05
    audit: int = 200
    goal: float = 0.98
    widest: int = 4
    clusters: int = 4096
    levels: int = 4
    sample: int = 16


def unit(v) -> np.ndarray | None:
    """The vector in double precision at length 1; None if it can't be compared."""
    if v is None or not len(v) or any(x is None for x in v):
        return None
    a = np.array(v, np.float64)
    if not np.isfinite(a).all() or not a.any():
        return None
    a = a / np.abs(a).max()
    return a / np.sqrt((a * a).sum())


def prepare(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, key (hash of the exact vector, null if it links with nothing), v (unit vector)."""

    def run(batch: pa.RecordBatch) -> dict:
        raw = batch.column(1).to_pylist()
        units = [unit(v) for v in raw]
        keys = [None if u is None else xxhash.xxh3_128_digest(np.array(v, np.float64).tobytes()) for u, v in zip(units, raw, strict=True)]
        return {"id": batch.column(0), "key": pa.array(keys, pa.binary()), "v": pa.array(units, pa.list_(pa.float64()))}

    return map_slices(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")), "id long, key binary, v array<double>", run)


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    c = sample[np.random.default_rng(0).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        own = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums**2).sum(1, keepdims=True))
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def drawn(rows: DataFrame, rate: Column, seed: int) -> DataFrame:
    """Rows of a share of the hashes of id; nothing is sorted."""
    return rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) < F.floor(rate * (1 << 40)))


def nearest(v: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
    """The m nearest centroids of each vector, the nearest first."""
    sims = v @ c.T
    m = min(m, len(c))
    top = np.argpartition(-sims, m - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(m), (len(v), 1))
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)


def deal(classes: DataFrame, s: Settings, overlap: int, n: int, dim: int) -> DataFrame:
    """(shard, id, size, v, home, shards): each vector in the shards of its ``overlap`` nearest centroids, of which the
    nearest is its home.

    The first centroids come from a sample on the driver. Shards that are larger than a task may take are split by
    centroids of their own, each in a task from a sample, until none is or the levels are used up; there a vector that is at
    home goes to the nearest ``overlap`` parts again, and others to the nearest one. So the number of centroids grows with
    the table, and none but the first are gathered.
    """
    spark = classes.sparkSession
    k = max(1, min(s.clusters, math.ceil(n * overlap / s.shard) if n > s.shard else 1))
    taken = drawn(classes, F.lit(min(1.0, k * s.sample / max(n, 1))), 1).select("id", "v").collect()
    taken = taken or classes.limit(1).select("id", "v").collect()
    sample = np.array([r.v for r in sorted(taken)]).reshape(-1, dim)
    shared = spark.sparkContext.broadcast(centroids(sample, k).astype(np.float32))

    def first(batch: pa.RecordBatch) -> dict:
        top = nearest(np.array(batch.column(2).flatten(), np.float32).reshape(-1, dim), shared.value, overlap)
        return {"id": batch.column(0), "size": batch.column(1), "v": batch.column(2), "near": pa.array(top.tolist(), pa.list_(pa.int64()))}

    near = map_slices(classes.select("id", "size", "v"), "id long, size long, v array<double>, near array<long>", first)
    rows = settle(near.select("id", "size", "v", F.posexplode("near").alias("at", "shard")))

    def parts_of(t: pa.Table) -> pa.Table:
        order = np.argsort(np.array(t.column("id")))
        v = np.array(t.column("v").combine_chunks().flatten()).reshape(-1, dim)[order]
        made = centroids(v, min(s.clusters, t.column("k")[0].as_py()))
        return pa.table({"shard": t.column("shard").slice(0, 1), "centres": pa.array([made.ravel().tolist()], pa.list_(pa.float64()))})

    def part(left: pa.Table, right: pa.Table) -> pa.Table:
        c = np.array(right.column("centres").combine_chunks().flatten(), np.float32).reshape(-1, dim) if len(right) else np.zeros((1, dim), np.float32)
        v = np.array(left.column("v").combine_chunks().flatten(), np.float32).reshape(-1, dim)
        top, home = nearest(v, c, overlap), np.array(left.column("at")) == 0
        take = home[:, None] | (np.arange(top.shape[1]) == 0)
        r, q = np.nonzero(take)
        own = left.take(pa.array(r))
        return pa.table({"id": own["id"], "size": own["size"], "v": own["v"], "at": pa.array(np.where(home[r], q, np.array(own["at"])), pa.int32()), "shard": own["shard"], "part": pa.array(top[r, q], pa.int64())})

    for level in range(s.levels):
        large = rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > s.most)
        large = settle(large.withColumn("k", F.least(F.lit(s.clusters), F.ceil(F.col("n") / s.shard)).cast("int")))
        if large.isEmpty():
            break
        joined = rows.join(large, "shard")
        made = drawn(joined, F.least(F.lit(1.0), F.col("k") * s.sample / F.col("n")), level + 2).select("shard", "id", "v", "k").groupBy("shard").applyInArrow(parts_of, "shard long, centres array<double>")
        salted = joined.withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 20_000))).select("shard", "salt", "id", "size", "v", "at")
        sent = made.join(large, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 20_000) - 1)).alias("salt"), "centres")
        dealt = salted.groupBy("shard", "salt").cogroup(sent.groupBy("shard", "salt")).applyInArrow(part, "id long, size long, v array<double>, at int, shard long, part long")
        named = dealt.withColumn("shard", F.xxhash64("shard", "part")).drop("part")
        rows = settle(rows.join(large, "shard", "left_anti").unionByName(named))
    lists = rows.groupBy("id").agg(F.min_by("shard", "at").alias("home"), F.collect_set("shard").alias("shards"))  # a few shards a vector
    return settle(rows.drop("at").distinct().join(lists, "id").select("shard", "id", "size", "v", "home", "shards"))


def robust_prune(v: np.ndarray, own: np.ndarray, candidates: np.ndarray, s: Settings) -> np.ndarray:
    """For each node up to ``degree`` of its candidates (-1: none): one stays unless one kept before is nearer to it by ``alpha``."""
    order = np.sort(candidates, 1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    order[order == own[:, None]] = -1
    around = v[order]
    mine = np.where(order >= 0, np.einsum("bmd,bd->bm", around, v[own]), -2)
    by = np.argsort(-mine, axis=1, kind="stable")[:, : 3 * s.degree]
    order, mine, around = np.take_along_axis(order, by, 1), np.take_along_axis(mine, by, 1), np.take_along_axis(around, by[:, :, None], 1)
    distance = np.sqrt(np.maximum(2 - 2 * mine, 0))
    between = np.sqrt(np.maximum(2 - 2 * (around @ around.transpose(0, 2, 1)), 0))
    alive, kept = order >= 0, np.zeros(order.shape, bool)
    for j in range(order.shape[1]):
        take = alive[:, j] & (kept.sum(1) < s.degree)
        kept[:, j] = take
        alive &= ~(take[:, None] & (s.alpha * between[:, j] <= distance))
        alive[:, j] = False
    place = np.argsort(~kept, axis=1, kind="stable")[:, : s.degree]
    out = np.full((len(own), s.degree), -1)
    out[:, : place.shape[1]] = np.where(np.take_along_axis(kept, place, 1), np.take_along_axis(order, place, 1), -1)
    return out


def medoids(v: np.ndarray, s: Settings) -> np.ndarray:
    """The vectors nearest to a few centroids; searches start there."""
    k = min(s.medoids, max(1, math.isqrt(len(v))))
    return np.unique((v @ centroids(v, k, 4).T.astype(v.dtype)).argmax(0))


def greedy(v: np.ndarray, table: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int, cut: float = 2.0) -> tuple:
    """Searches the graph for each query vector from some nodes: (nodes of the beam, -1 where it isn't full; queries by
    nodes, which were looked at; query, node and similarity of those looked at that are as near as ``cut``). Only nodes that
    are reached are compared."""
    n, beam = len(queries), max(beam, len(starts))
    seen = np.zeros((n, len(v)), bool)
    seen[:, starts] = True
    ids, sims, done = np.full((n, beam), -1), np.full((n, beam), -3.0, np.float32), np.ones((n, beam), bool)
    ids[:, : len(starts)], sims[:, : len(starts)], done[:, : len(starts)] = starts, queries @ v[starts].T, False
    q, k = np.nonzero(sims >= cut)
    reached = [(q, ids[q, k], sims[q, k])]
    live = np.arange(n)
    while len(live):
        score = np.where(done[live], -4, sims[live])
        at = score.argmax(1)
        go = score[np.arange(len(live)), at] > -3
        live, at = live[go], at[go]
        if not len(live):
            break
        done[live, at] = True
        around = table[ids[live, at]]
        fresh = (around >= 0) & ~seen[live[:, None], around]
        r, c = np.nonzero(fresh)
        q, x = live[r], around[r, c]
        seen[q, x] = True
        new = np.full(around.shape, -3.0, np.float32)
        new[r, c] = close = np.einsum("ij,ij->i", v[x], queries[q])
        near = close >= cut
        reached.append((q[near], x[near], close[near]))
        all_ids, all_sims = np.concatenate([ids[live], np.where(fresh, around, -1)], 1), np.concatenate([sims[live], new], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live], sims[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_done))
    return ids, seen, tuple(np.concatenate(x) for x in zip(*reached, strict=True))


def build_graph(v: np.ndarray, s: Settings) -> np.ndarray:
    """Neighbours of each node (-1: none). The medoids come first, the others in batches that double: each is searched for in the graph so far, and
    what the search ends at, near ones of its own batch and some drawn at random are its candidates for robust pruning;
    links back are pruned likewise."""
    n = len(v)
    rng = np.random.default_rng(n)
    order = rng.permutation(n)
    table = np.full((n, s.degree), -1)
    starts = medoids(v, s)
    order = np.concatenate([starts, order[~np.isin(order, starts)]])
    table[starts] = robust_prune(v, starts, np.tile(starts, (len(starts), 1)), s)
    at = size = len(starts)
    while at < n:
        batch = order[at : at + size]
        found = greedy(v, table, v[batch], starts, s.beam)[0]
        drawn_ones = order[rng.integers(0, at, (len(batch), s.far))]
        inside = v[batch] @ v[batch].T
        close = batch[np.argsort(-inside, axis=1, kind="stable")[:, : s.near + 1]]
        table[batch] = robust_prune(v, batch, np.concatenate([found, drawn_ones, close], 1), s)
        r, c = np.nonzero(table[batch] >= 0)
        back, new = table[batch][r, c], batch[r]
        by = np.argsort(back, kind="stable")
        back, new = back[by], new[by]
        heads, first, counts = np.unique(back, return_index=True, return_counts=True)
        slot = np.arange(len(back)) - np.repeat(first, counts)
        grown = np.full((len(heads), s.degree + max(1, min(int(counts.max(initial=0)), 4 * s.degree))), -1)
        grown[:, : s.degree] = table[heads]
        fits = slot < grown.shape[1] - s.degree
        grown[np.repeat(np.arange(len(heads)), counts)[fits], s.degree + slot[fits]] = new[fits]
        table[heads] = robust_prune(v, heads, grown, s)
        at, size = at + size, min(2 * size, s.batch)
    return table


def range_search(v: np.ndarray, table: np.ndarray, queries: np.ndarray, threshold: float, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of what the search reached at ``threshold`` less a margin for single precision, a batch of queries at a time; queries are nodes.

    A greedy search with a beam starts at the medoids; then everything that lies within ``slack`` of the threshold is
    expanded until nothing new turns up. Only nodes that are reached are compared.
    """
    starts = medoids(v, s)
    for at in range(0, len(queries), s.batch):
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        own = queries[at : at + s.batch]
        _, seen, (q, x, near) = greedy(v, table, v[own], starts, s.beam, threshold - s.slack)
        while len(q):
            hit = near >= threshold - 1e-3
            left.append(own[q[hit]])
            right.append(x[hit])
            next_q, next_x, next_near = [], [], []
            for k in range(0, len(q), 20_000):
                around = table[x[k : k + 20_000]]
                r, c = np.nonzero((around >= 0) & ~seen[q[k : k + 20_000, None], around])
                pair = np.unique(q[k + r] * len(v) + around[r, c])
                a, y = pair // len(v), pair % len(v)
                seen[a, y] = True
                close = np.einsum("ij,ij->i", v[own[a]], v[y])
                keep = close >= threshold - s.slack
                next_q.append(a[keep])
                next_x.append(y[keep])
                next_near.append(close[keep])
            q, x, near = (np.concatenate(z) for z in (next_q, next_x, next_near))
        yield np.concatenate(left), np.concatenate(right)


def smallest_label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def exact(v: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair is linked, in double precision."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 100_000):
        out[at : at + 100_000] = (v[i[at : at + 100_000]] * v[j[at : at + 100_000]]).sum(1) >= threshold
    return out


def tally(ids: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, counted: np.ndarray) -> pa.Table:
    """(id, linked, root) of links a to b, of which the ``counted`` add the size of b to a."""
    linked = np.zeros(len(ids), np.int64)
    np.add.at(linked, a[counted], sizes[b[counted]])
    return pa.table({"id": pa.array(ids), "linked": pa.array(linked), "root": pa.array(ids[smallest_label(len(ids), a, b)])})


class Links:
    """Links among ``n`` nodes, a bit each, read some rows at a time."""

    ROWS = 256

    def __init__(self, n: int):
        self.n = n
        self.bits = np.zeros((n, (n + 7) // 8), np.uint8)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        some, at = np.unique(i, return_inverse=True)
        rows = np.zeros((len(some), self.n), bool)
        rows[at, j] = True
        self.bits[some] |= np.packbits(rows, axis=1, bitorder="little")

    def rows(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Slices of rows, with what each row links to or is linked from by a row; nothing where it has no link of its own side."""
        for at in range(0, self.n, self.ROWS):
            own = slice(at, min(at + self.ROWS, self.n))
            there = np.unpackbits(self.bits[own], axis=1, count=self.n, bitorder="little").view(bool)
            back = np.unpackbits(self.bits[:, at // 8 : (own.stop + 7) // 8], axis=1, bitorder="little").view(bool)[:, : own.stop - at].T
            yield own, there | back


def shard_links(t: pa.Table, threshold: float, s: Settings) -> pa.Table:
    """(id, linked, root) of one shard's vectors (shard, id, size, v, home, shards, next); see link_counts().

    Links are kept as bits, the square of the shard in eighths of a byte, and all counts are sums over some rows of them; no
    list of pairs is held beyond a batch of queries.
    """
    t, ids, v = in_order(t, np.float64)
    n, sizes, own, home = len(ids), np.array(t.column("size")), t.column("shard")[0].as_py(), np.array(t.column("home"))
    lists = [np.array(a or [], np.int64) for a in t.column("next").to_pylist()]
    table = np.full((n, max(1, max(map(len, lists)))), -1)
    for i, a in enumerate(lists):
        at = np.minimum(np.searchsorted(ids, a), n - 1)
        at = at[ids[at] == a]
        table[i, : len(at)] = at
    found = Links(n)
    for i, j in range_search(v.astype(np.float32), table, np.flatnonzero(home == own), threshold, s):
        good = (i != j) & exact(v, i, j, threshold)
        found.add(i[good], j[good])
    homes, at_home = np.unique(home, return_inverse=True)
    number = {h: k for k, h in enumerate(homes.tolist())}
    held = np.zeros((n, len(homes)), bool)  # whether a vector lies in a shard that is some vector's home
    for x, some in enumerate(t.column("shards").to_pylist()):
        held[x, [number[h] for h in some if h in number]] = True
    linked, label, before, mine = np.zeros(n, np.int64), np.arange(n), None, home == own
    for rows, met in found.rows():
        met = met & mine[rows, None]  # only what is at home here counts; a link between two such counts both ways
        linked[rows] += met @ sizes
        alone = met & ~mine & ~held[rows][:, at_home]
        linked += sizes[rows] @ alone
    while before is None or (label != before).any():
        before = label.copy()
        for rows, met in found.rows():
            low = np.minimum(np.where(met, label, n).min(axis=1), label[rows])
            label = np.minimum(label, np.where(met, low[:, None], n).min(axis=0))
            label[rows] = np.minimum(label[rows], low)
        label = label[label]
    return pa.table({"id": pa.array(ids), "linked": pa.array(linked), "root": pa.array(ids[label])})


def in_order(t: pa.Table, kind) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A shard's rows by id, their ids and vectors."""
    t = t.take(pa.array(np.argsort(np.array(t.column("id")))))
    ids = np.array(t.column("id"))
    return t, ids, np.array(t.column("v").combine_chunks().flatten(), kind).reshape(len(ids), -1)


def link_counts(dealt: DataFrame, threshold: float, s: Settings) -> DataFrame:
    """(id, linked, root) a shard and vector: vectors linked with it that count here (copies counted) and the least id of its group here.

    Graphs are built shard by shard and the adjacency lists of a vector are put together. Each vector is searched for in
    its home over these lists, once. What it finds there counts for it; it counts for the other one too where that one
    has no chance to find it, since its home lacks this vector. So a pair of several common shards counts once for either.
    Cosines are taken in double precision.
    """

    def build(t: pa.Table) -> pa.Table:
        t, ids, v = in_order(t, np.float32)
        table = build_graph(v, s)
        return pa.table({"id": pa.array(ids), "next": pa.array([ids[a[a >= 0]].tolist() for a in table], pa.list_(pa.int64()))})

    built = dealt.select("shard", "id", "v").groupBy("shard").applyInArrow(build, "id long, next array<long>")
    joined = built.select("id", F.explode("next").alias("next")).groupBy("id").agg(F.collect_set("next").alias("next"))  # degree times shards

    def search(t: pa.Table) -> pa.Table:
        return shard_links(t, threshold, s)

    searched = dealt.join(joined, "id", "left").select("shard", "id", "size", "v", "home", "shards", "next")
    return settle(searched.groupBy("shard").applyInArrow(search, "id long, linked long, root long"))


def all_link_counts(classes: DataFrame, n: int, threshold: float, s: Settings) -> DataFrame:
    """link_counts() of all pairs of vectors, compared in blocks without an index; its work grows with the square of n."""
    blocks = math.ceil(n / s.block)
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    sent = classes.withColumn("own", own).withColumn("other", other)
    placed = sent.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "size", "v")

    def compare(t: pa.Table) -> pa.Table:
        ids, sizes, block = np.array(t.column("id")), np.array(t.column("size")), np.array(t.column("own"))
        v = np.array(t.column("v").combine_chunks().flatten()).reshape(len(ids), -1)
        one = np.flatnonzero(block == t.column("p")[0].as_py())
        two = np.flatnonzero(block == t.column("q")[0].as_py())
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(one), 256):
            i, j = np.nonzero(v[one[at : at + 256]] @ v[two].T >= threshold - 1e-9)
            i, j = one[at + i], two[j]
            good = (i != j) & exact(v, i, j, threshold)
            a.append(i[good])
            b.append(j[good])
        i, j = np.concatenate(a), np.concatenate(b)
        if t.column("p")[0] != t.column("q")[0]:
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
        return tally(ids, sizes, i, j, np.ones(len(i), bool))

    return settle(placed.groupBy("p", "q").applyInArrow(compare, "id long, linked long, root long"))


def audit(classes: DataFrame, linked: DataFrame, threshold: float, queries: int, dim: int) -> float:
    """Mean share of the true links of a vector, found by comparing it with every vector in blocks, that were found.

    Vectors that link with others are drawn by a hash; where fewer than a quarter of the queries do, more are drawn, up to
    16 times as many. Without a link among them the recall is 1.
    """
    wanted, total = queries, classes.count()
    while True:
        chosen = drawn(classes, F.lit(min(1.0, queries / max(total, 1))), 99).select("id", "v").collect()
        shared = classes.sparkSession.sparkContext.broadcast((np.array([r.id for r in chosen]), np.array([r.v for r in chosen]).reshape(-1, dim)))

        def count(batch: pa.RecordBatch, shared=shared) -> dict:
            ids, q = shared.value
            v = np.array(batch.column(2).flatten()).reshape(-1, dim)
            near = (v @ q.T >= threshold) & (np.array(batch.column(0))[:, None] != ids[None])
            return {"id": pa.array(ids, pa.int64()), "true": pa.array((near * np.array(batch.column(1))[:, None]).sum(0), pa.int64())}

        true = map_slices(classes.select("id", "size", "v"), "id long, true long", count).groupBy("id").agg(F.sum("true").alias("true")).where(F.col("true") > 0)
        share = F.least(F.coalesce("linked", F.lit(0)) / F.col("true"), F.lit(1.0))
        n, recall = true.join(linked, "id", "left").agg(F.count("*"), F.avg(share)).first()
        if 4 * n >= wanted or queries >= min(total, 16 * wanted):
            return 1.0 if not n else recall
        queries *= 4


def _graph(classes: DataFrame, n: int, dim: int, threshold: float, s: Settings) -> DataFrame:
    """link_counts() of the ``n`` classes of one length, at a recall of the goal or of all pairs."""
    main = classes.where(F.size("v") == dim).select("id", "v", "size")
    overlap = s.overlap
    while True:
        links = link_counts(deal(main, s, overlap, n, dim), threshold, s)
        recall = audit(main, links.groupBy("id").agg(F.sum("linked").alias("linked")), threshold, s.audit, dim)
        log.warning("recall %.4f at an overlap of %d shards, goal %.4f", recall, overlap, s.goal)
        if recall >= s.goal:
            return links
        if overlap >= s.widest * s.overlap:
            return all_link_counts(main, n, threshold, s)
        overlap *= 2


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept: vectors linked at a cosine of ``threshold`` or more, in double precision.

    Equal vectors are one class with all links among them, and a node of its own even where rows of one id have several.
    Every vector is in the index. Long vectors are held as they are, a shard of them in a task. Recall is audited against brute force; below the goal the shards overlap more and the search is repeated;
    where the widest overlap misses it too, all pairs are compared. The log tells the recall.
    Vectors of each length have a graph of their own; those of different lengths don't link. Vectors that are null, empty,
    zero, or hold a null or non-finite component link with nothing. Rows of one id are one vertex and count as a link each; a null
    id links with nothing: its component is null and it is kept. An empty table gives no rows; other columns are ignored.
    """
    s = settings or Settings()
    rows = settle(prepare(df, id_col, vec_col))
    usable = rows.where("key is not null and id is not null")
    firsts = usable.groupBy("key").agg(F.min(F.struct("id", "v")).alias("f"), F.count("*").alias("size"))
    classes = settle(firsts.select("key", F.col("f.id").alias("first"), "f.v", "size").withColumn("id", F.monotonically_increasing_id()))  # written once, so that numbers stay
    shapes = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").collect()  # lengths are few
    graphs = [_graph(classes, shape.n, shape.dim, threshold, s) for shape in shapes if shape.n > 1]
    links = reduce(DataFrame.unionByName, graphs) if graphs else df.sparkSession.createDataFrame([], "id long, linked long, root long")
    totals = links.groupBy("id").agg(F.sum("linked").alias("linked"))
    # Rows of one id with several vectors tie their classes together.
    repeated = usable.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("id").alias("own"))
    several = usable.join(repeated, usable.id == repeated.own, "left_semi").join(classes.select("key", F.col("id").alias("node")), "key").select("id", "node").distinct()
    ties = several.join(several.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b")
    reached = settle(components(links.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(ties)))
    numbers = classes.select(F.col("id").alias("node"), "key", "first", "size")
    least = reached.join(numbers, "node").groupBy("component").agg(F.min("first").alias("least"))
    joined = numbers.join(totals.withColumnRenamed("id", "node"), "node", "left").join(reached, "node", "left").join(least, "component", "left")
    named = settle(joined.select("key", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component")))
    out = rows.select("id", "key").withColumn("key", F.when(F.col("id").isNotNull(), F.col("key"))).join(named, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
