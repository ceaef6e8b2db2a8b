import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from lexweave.llm import queries, vecgraph

SF = "/root/testdata/sf0.01"
VECS = "vec_id long, embedding array<float>, v string, size string"


def brute(rows, threshold=0.95):
    """rows of (id, vector); all pairs in double precision."""
    good = [(i, vecgraph.unit(v)) for i, v in rows]
    parent = {i: i for i, _ in rows}
    links = dict.fromkeys(parent, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [(i, u) for i, u in good if u is not None]
    m = np.array([u for _, u in good])
    ids = [i for i, _ in good]
    for a, b in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1)), strict=True):
        links[ids[a]] += 1
        links[ids[b]] += 1
        x, y = find(ids[a]), find(ids[b])
        parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i in parent}


def got(df, **settings):
    return {r.vec_id: tuple(r)[1:] for r in vecgraph.near_duplicate_vectors(df, settings=vecgraph.Settings(**settings)).collect()}


def test_vectors_against_all_pairs(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {r.vec_id: tuple(r)[1:] for r in queries.op7_vecgraph(spark, SF).collect()} == brute(rows)


@pytest.mark.parametrize("settings", [{}, {"shard": 60, "most": 100}, {"shard": 60, "most": 100, "clusters": 3, "levels": 3}])
def test_groups_of_copies_and_near_copies(spark, settings):
    """Small shards, so that they overlap and the hot group is split, also by a tree of few centroids."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 16))
    rows = [base[i] for i in range(150)]
    rows += [base[i // 4] + rng.normal(size=16) * 0.15 for i in range(200)]
    rows += [base[7]] * 40
    rows += [base[9] + rng.normal(size=16) * 0.1 for _ in range(160)]
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]
    want, have = brute(rows), got(spark.createDataFrame([(*r, "x", "y") for r in rows], VECS), **settings)
    assert sum(h[0] for h in have.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert all(have[i][0] <= want[i][0] for i in want)
    assert sum(have[i][1] == want[i][1] for i in want) >= 0.97 * len(want)


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.01]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, []), (9, [-1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [0.0, 0.0]), (13, [float("inf"), 1.0])]
    have = got(spark.createDataFrame([(*r, None, None) for r in rows], VECS))
    assert {i: have[i][:2] for i in (1, 2, 3)} == {1: (2, 1), 2: (2, 1), 3: (2, 1)}
    assert {i: have[i] for i in (4, 5, 6, 7, 8, 9, 12, 13)} == {i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 12, 13)}
    assert have[10] == (1, 10, True) and have[11] == (1, 10, False)
    same = spark.createDataFrame([(1, [1.0, 0.0], None, None), (1, [0.0, 1.0], None, None), (5, [0.0, 1.0], None, None), (None, [0.0, 1.0], None, None)], VECS)
    out = sorted((r.vec_id or -1, r.component_id, r.kept) for r in vecgraph.near_duplicate_vectors(same).collect())
    assert out == [(-1, None, True), (1, 1, True), (1, 1, True), (5, 1, False)]
    assert got(same.limit(0)) == {}


def test_pairs_of_two_shards_count_once_for_either(spark):
    """All vectors lie in two shards and are at home in one; a third is seen as a visitor by vectors that its home lacks."""
    rng = np.random.default_rng(8)
    vectors = [vecgraph.unit(v).tolist() for v in 1 + rng.normal(size=(13, 8)) * 0.02]
    rows = [(shard, i, 1, v, 1 + i % 2, [1, 2]) for shard in (1, 2) for i, v in enumerate(vectors[:12])]
    rows += [(1, 12, 1, vectors[12], 3, [1, 3]), (3, 12, 1, vectors[12], 3, [1, 3])]
    dealt = spark.createDataFrame(rows, "shard long, id long, size long, v array<double>, home long, shards array<long>")
    have = vecgraph.link_counts(dealt, 0.95, vecgraph.Settings()).collect()
    # Those at home in shard 2 don't meet the visitor of shard 1 in a home of either.
    want = {i: 12 if i % 2 == 0 else 11 for i in range(12)} | {12: 6}
    assert {i: sum(r.linked for r in have if r.id == i) for i in range(13)} == want
    assert {r.root for r in have if r.id != 12} == {0}


def test_graph_search_reaches_small_groups_beside_a_dense_one():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(60, 64))
    v = np.concatenate([c[rng.integers(0, 60, 900)] + rng.normal(size=(900, 64)) * 0.9, c[0] + rng.normal(size=(300, 64)) * 0.15, c[1:].repeat(3, 0) + rng.normal(size=(177, 64)) * 0.12])
    v = (v / np.sqrt((v**2).sum(1, keepdims=True))).astype(np.float32)
    s = vecgraph.Settings()
    table = vecgraph.build_graph(v, s)
    assert table.shape == (len(v), s.degree) and all(len(set(a[a >= 0])) == (a >= 0).sum() for a in table)
    i, j = (np.concatenate(x) for x in zip(*vecgraph.range_search(v, table, np.arange(len(v)), 0.95, s), strict=True))
    near = v @ v.T >= 0.95
    found = np.eye(len(v), dtype=bool)
    found[i, j] = True
    recall = (found & near).sum(1) / near.sum(1)
    print("recall by vector", recall.mean())
    assert recall.mean() > 0.99 and not (found & (v @ v.T < 0.948)).any()


def test_a_dense_full_shard_is_counted_in_little_memory():
    """Nearly all of 4,000 vectors link with each other: some 15 million pairs."""
    rng = np.random.default_rng(1)
    s, n = vecgraph.Settings(), vecgraph.Settings().most
    v = np.concatenate([1 + rng.normal(size=(n - 40, 64)) * 0.16, rng.normal(size=(40, 64))])
    v = np.array([vecgraph.unit(x) for x in v])
    table = vecgraph.build_graph(v.astype(np.float32), s)
    home = np.where(np.arange(n) % 10 == 3, 2, 1)
    shard = pa.table({
        "shard": [1] * n, "id": range(n), "size": [1 + i % 3 for i in range(n)], "v": v.tolist(), "home": home.tolist(),
        "shards": [[1, 2] if h == 2 or i % 2 else [1] for i, h in enumerate(home.tolist())], "next": [a[a >= 0].tolist() for a in table],
    })
    tracemalloc.start()
    out = vecgraph.shard_links(shard, 0.95, s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6, peak
    near = (v @ v.T >= 0.95) & ~np.eye(n, dtype=bool)
    mine, sizes = home == 1, 1 + np.arange(n) % 3
    found = np.zeros((n, n), bool)
    for i, j in vecgraph.range_search(v.astype(np.float32), table, np.flatnonzero(mine), 0.95, s):
        found[i, j] = True
    found &= near
    counted = (found | found.T) & mine[:, None]
    assert found.sum() > 10_000_000 and counted.sum() > 0.95 * (near & mine[:, None]).sum()
    lone = counted & ~mine & (np.arange(n) % 2 == 0)[:, None]  # a visitor whose home lacks the one that found it
    assert (np.array(out.column("linked")) == counted @ sizes + sizes @ lone).all()
    root = np.array(out.column("root"))
    assert (root[: n - 40][mine[: n - 40]] == 0).all() and (root[n - 40 :] == np.arange(n - 40, n)).all()


def test_ids_with_several_vectors_have_the_links_of_each(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (5, [1.0, 0.05]), (6, [0.05, 1.0]), (7, [-1.0, 0.3])]
    for parts in (1, 4):
        df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECS).repartition(parts, "embedding")
        have = sorted((r.vec_id, r.n_links, r.component_id) for r in vecgraph.near_duplicate_vectors(df).collect())
        assert have == [(1, 1, 1), (1, 1, 1), (5, 1, 1), (6, 1, 1), (7, 0, 7)]


def test_audit_sees_lost_small_groups_beside_a_hot_one(spark):
    """Forty vectors that all link with each other, found, and twenty pairs, lost."""
    eye = np.eye(32)
    vectors = [eye[0]] * 40 + [eye[1 + i // 2] for i in range(40)]
    classes = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "id long, v array<double>, size long")
    linked = spark.createDataFrame([(i, 39) for i in range(40)], "id long, linked long")
    assert vecgraph.audit(classes, linked, 0.95, 200, 32) == 0.5


def test_all_pairs_where_the_widest_overlap_misses_the_goal(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i // 4] + rng.normal(size=16) * 0.1]) for i in range(120)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECS)
    assert got(df, degree=0, widest=1, block=20) == brute(rows)


def test_vectors_of_each_length_link(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0]), (6, [1.0])]
    have = got(spark.createDataFrame([(*r, "x", "y") for r in rows], VECS))
    assert have == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (0, 6, True)}
