import math
import random
import re
import zlib

import numpy as np
import pytest
from lexweave.llm import components, langid, minhash, quality, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string, component_id string, id long"


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute_components(texts, width, percent):
    """texts: id -> text. Components of all pairs by a plain loop over exact word runs."""
    sets = {}
    for i, t in texts.items():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= max(len(x), len(y)) * percent:
                both = len(x & y)
                if both * 100 >= (len(x) + len(y) - both) * percent:
                    ra, rb = find(parent, a), find(parent, b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(parent, i)) for i in ids}


def test_minhash_against_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_minhash(spark, SF).collect()
    want = brute_components(texts, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert sum(not r.kept for r in rows) > 20


def test_minhash_of_hot_and_mixed_groups(spark):
    """A large group of copies, a large group of near copies, and short texts, against all pairs."""
    base = [f"w{i}" for i in range(60)]
    texts = {i: "same text in every row of this group" for i in range(0, 300, 3)}
    texts |= {i: " ".join([*base[: i % 50], f"x{i}", *base[i % 50 :]]) for i in range(1, 300, 3)}
    texts |= {i: " ".join(base[: 5 + i % 17]) for i in range(2, 300, 3)}
    texts |= {1000: "", 1001: None, 1002: "One", 1003: "one", 1004: "ONE two"}
    df = spark.createDataFrame([(i, t, None, None, "x", 5) for i, t in texts.items()], DOCS)
    want = brute_components(texts, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 2, 80).collect()} == want


@pytest.mark.parametrize("block", [6, 1000])
def test_minhash_links_that_no_star_finds(spark, monkeypatch, block):
    """Walks away from one text: large buckets in which many links lie far from any centre, against all pairs."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "ALL_PAIRS", 1)
    monkeypatch.setattr(minhash, "STARS", (1,))
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(150)], {}
    for walk in range(30):
        words = list(base)
        for step in range(6):
            for _ in range(rng.choice([2, 6, 8, 9])):
                words[rng.randrange(len(words))] = f"x{walk}.{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(words[: rng.choice([150, 150, 130])])
    df = spark.createDataFrame([(i, t, None, None, "x", 5) for i, t in texts.items()], DOCS)
    want = brute_components(texts, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 2, 80).collect()} == want
    assert len({c for _, c in want.values()}) > 5


def test_screen_leaves_no_alike_pair_out():
    rng = np.random.default_rng(3)
    pool = rng.integers(-(2**63), 2**63 - 1, 4000)
    for size in (1, 4, 30, 400, 3000):
        core = rng.choice(pool, size, replace=False)
        sets = [np.unique(np.concatenate([rng.permutation(core)[: max(1, int(size * share))], rng.choice(pool, size // 8)])) for share in rng.uniform(0.7, 1, 25)]
        bits = [np.packbits(np.bincount(s & (minhash.BITS - 1), minlength=minhash.BITS) & 1) for s in sets]
        m = {"id": np.arange(25), "n": np.array([len(s) for s in sets]), "class": np.arange(25) // 2, "asks": np.arange(25) % 3 == 0, "sketch": np.stack(bits).view(np.uint64)}
        asking = np.flatnonzero(m["asks"])
        i, j = minhash.screen({k: x[asking] for k, x in m.items()}, m, 80)
        got = sorted(tuple(sorted((int(asking[a]), int(b)))) for a, b in zip(i, j, strict=True))
        assert len(set(got)) == len(got)
        for a in range(25):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                alike = both * 100 >= (len(sets[a]) + len(sets[b]) - both) * 80
                apart = m["class"][a] != m["class"][b] and (m["asks"][a] or m["asks"][b])
                assert not (alike and apart) or (b, a) in got


def test_minhash_of_ids_with_several_texts(spark):
    """An id has the links of all its texts, whichever row comes first."""
    one, two = ([f"{x}{i}" for i in range(60)] for x in "pq")
    near = lambda words, k: " ".join([*words[:k], "new", *words[k:]])
    texts = [(1, " ".join(one)), (1, " ".join(two)), (6, near(one, 9)), (7, near(two, 30)), (8, near(one, 40)), (3, "x y z"), (4, "x y z"), (4, " ".join([*two, "end"]))]
    df = spark.createDataFrame([(i, t, None, None, "x", 5) for i, t in texts], DOCS)
    for parts in (1, 5):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df.repartition(parts, "text"), 2, 80).collect()}
        assert got == {1: 1, 6: 1, 7: 1, 8: 1, 4: 1, 3: 1}


def test_minhash_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c", None, None, None, 1), (1, "d e f", None, None, None, 1), (2, "a b c", None, None, None, 1), (3, "d e f", None, None, None, 1), (None, "a b c", None, None, None, 1), (9, "q " * 5000, None, None, None, 1)], DOCS)
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in minhash.near_duplicates(df, 2, 80).collect())
    assert rows == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (9, 9, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {199: 199, 200: 199}


def test_language_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op3_langid(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    held = [(rows[d.doc_id], d.lang) for d in docs if rows[d.doc_id].held_out]
    assert sum(r.lang_pred == lang for r, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_of_odd_rows(spark):
    rows = [(i, f"the cat and the dog {i} of", "en", None, None, 0) for i in range(30)] + [(i, f"der hund und die katze {i} von", "de", None, None, 0) for i in range(30, 60)]
    odd = [(100, None, "en", None, None, 0), (101, "", None, None, None, 0), (102, "123 !!", "en", None, None, 0), (None, "und der die " * 3000, None, None, None, 0), (100, "the of", None, None, None, 0)]
    out = langid.identify(spark.createDataFrame(rows + odd, DOCS)).collect()
    assert len(out) == 65
    assert sorted(r.lang_pred for r in out[60:]) == ["de", "en", "und", "und", "und"]
    assert [r.score for r in out if r.lang_pred == "und"] == [0.0] * 3
    nothing = spark.createDataFrame([(1, "text", None, None, None, 0)], DOCS)
    assert [r.lang_pred for r in langid.identify(nothing).collect()] == ["und"]
    assert langid.identify(nothing.limit(0)).count() == 0


def test_the_sample_of_a_language_is_bounded(spark, monkeypatch):
    """Rows without id, rows of one id and equal rows: the driver gets the bound and some more, no ties without end."""
    rows = [(None, f"the cat {i}", "en") for i in range(3000)] + [(None, "same text", "en")] * 3000 + [(7, f"der hund {i}", "de") for i in range(3000)] + [(8, "le chat", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    collected, taught = [], []
    collect, learn = type(df).collect, langid.Ftrl.learn
    monkeypatch.setattr(type(df), "collect", lambda self: (collected.append(x := collect(self)), x)[1])
    monkeypatch.setattr(langid.Ftrl, "learn", lambda self, *x: (taught.append(x[2]), learn(self, *x))[1])
    model = langid.fit(df, per_language=100, epochs=1)
    examples = [x for x in collected if x and "h" in x[0]]
    assert len(examples) == 1 and 200 < len(examples[0]) < 330
    assert len(taught) <= 201 and model.languages == ["de", "en", "fr"]


def test_fit_against_plain_loops(spark):
    """The same model from nested loops over the formulas of the method."""
    rows = [(i, f"the cat and {i % 9} dogs of", "en") for i in range(30)] + [(i, f"der hund und {i % 7} katzen", "de") for i in range(30, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, epochs=2)
    order = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id", "text")).collect()]
    grams = {i: {} for i, *_ in rows}
    for i, text, _ in rows:
        for b in langid.buckets(text).tolist():
            grams[i][b] = grams[i].get(b, 0) + 1
    share = {}
    for g in grams.values():
        for b in g:
            share[b] = share.get(b, 0) + 1
    vectors = {}
    for i, g in grams.items():
        x = {b: (1 + math.log(n)) * (math.log(61 / (1 + share[b])) + 1) for b, n in g.items()}
        size = math.sqrt(sum(q * q for q in x.values()))
        vectors[i] = {b: q / size for b, q in x.items()}
    label = {i: ["de", "en"].index(lang) for i, _, lang in rows}
    z, n = {}, {}

    def weight(b, k):
        a = z.get((b, k), 0.0)
        return 0.0 if abs(a) <= 0.02 else -(a - math.copysign(0.02, a)) / ((1.0 + math.sqrt(n.get((b, k), 0.0))) / 1.0 + 0.01)

    learnt, held = [i for k, i in enumerate(order) if k % 5], order[::5]
    for epoch in range(2):
        for at in np.random.default_rng(epoch).permutation(len(learnt)):
            i = learnt[at]
            w = {(b, k): weight(b, k) for b in vectors[i] for k in (0, 1)}
            odds = [math.exp(sum(q * w[b, k] for b, q in vectors[i].items())) for k in (0, 1)]
            for b, q in vectors[i].items():
                for k in (0, 1):
                    g = q * (odds[k] / sum(odds) - (k == label[i]))
                    before = n.get((b, k), 0.0)
                    z[b, k] = z.get((b, k), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) * w[b, k]
                    n[b, k] = before + g * g
    for b in range(langid.BUCKETS):
        for k in (0, 1):
            assert math.isclose(model.weights[b, k], weight(b, k), rel_tol=1e-9, abs_tol=1e-12)
    logits = np.array([[sum(q * weight(b, k) for b, q in vectors[i].items()) for k in (0, 1)] for i in held])
    grid = np.exp(np.linspace(-2, 3, 101))
    assert math.isclose(model.factor, max(grid, key=lambda t: sum(math.log(math.exp(t * x[label[i]]) / sum(math.exp(t * y) for y in x)) for i, x in zip(held, logits, strict=True))))


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op9_quality(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    assert sum(rows[r.doc_id].predicted == r.quality for r in labels) >= 0.95 * len(labels)
    ones, zeros = ([rows[r.doc_id].score for r in labels if r.quality == q] for q in (1, 0))
    assert sum(a > b for a in ones for b in zeros) >= 0.97 * len(ones) * len(zeros)


def test_quality_against_plain_loops(spark):
    """The discriminant from nested loops: moments, shrinkage, elimination for determinant and distance."""
    rng = random.Random(4)
    good = [" ".join(rng.choice(["The", "river", "runs", "slowly.", "We", "saw", "it,", "then"]) for _ in range(rng.randrange(20, 60))) for _ in range(40)]
    bad = [" ".join(rng.choice(["BUY", "now!!!", "$$$", "http://x", "click", "77"]) for _ in range(rng.randrange(3, 50))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate([*good, *bad])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(70)], "doc_id long, label int")
    have = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    rows, d = [quality.statistics(t) for t in [*good, *bad]], quality.SIZE
    mean = [sum(r[i] for r in rows) / 70 for i in range(d)]
    scale = [math.sqrt(max(sum((r[i] - mean[i]) ** 2 for r in rows) / 70, 1e-9)) for i in range(d)]
    z = [[(r[i] - mean[i]) / scale[i] for i in range(d)] for r in rows]
    groups = {1: z[:40], 0: z[40:]}
    centre = {c: [sum(r[i] for r in g) / len(g) for i in range(d)] for c, g in groups.items()}
    spread = {c: [[sum((r[i] - centre[c][i]) * (r[j] - centre[c][j]) for r in g) / len(g) for j in range(d)] for i in range(d)] for c, g in groups.items()}

    def log_density(x, c):
        a = [[0.0] * d for _ in range(d)]
        for i in range(d):
            for j in range(d):
                shared = sum(len(g) / 70 * spread[k][i][j] for k, g in groups.items())
                v = (1 - quality.POOL) * spread[c][i][j] + quality.POOL * shared
                a[i][j] = v + quality.RIDGE if i == j else v * (1 - quality.DIAGONAL)
        b = [x[i] - centre[c][i] for i in range(d)]
        whole, log_det = list(b), 0.0
        for i in range(d):  # elimination; the matrix is positive definite
            log_det += math.log(a[i][i])
            for k in range(i + 1, d):
                f = a[k][i] / a[i][i]
                for j in range(i, d):
                    a[k][j] -= f * a[i][j]
                b[k] -= f * b[i]
        solved = [0.0] * d
        for i in reversed(range(d)):
            solved[i] = (b[i] - sum(a[i][j] * solved[j] for j in range(i + 1, d))) / a[i][i]
        return math.log(len(groups[c]) / 70) - 0.5 * log_det - 0.5 * sum(p * q for p, q in zip(whole, solved, strict=True))

    for i in range(0, 70, 3):
        apart = log_density(z[i], 1) - log_density(z[i], 0)
        assert math.isclose(have[i], 1 / (1 + math.exp(-max(-500, min(500, apart)))), rel_tol=1e-4, abs_tol=1e-6)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 0), (2, "", None, None, None, 0), (None, "a b", None, None, None, 0), (2, "word " * 9000, None, None, None, 0)], DOCS)
    none = spark.createDataFrame([(1, None), (77, 1)], "doc_id long, label int")
    assert [r.score for r in quality.score_quality(docs, none).collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "doc_id long, label int")
    assert {r.predicted for r in quality.score_quality(docs, one).collect()} == {1}
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, both).collect())
    assert quality.score_quality(docs.limit(0), both).count() == 0


def test_statistics_are_finite():
    for text in ("", " ", "\n\n", "!!!", "é" * 10, "a" * 100000):
        assert all(abs(x) < 100 for x in quality.statistics(text)) and len(quality.statistics(text)) == quality.SIZE


@pytest.mark.parametrize("text", ["", "!?", "12 34"])
def test_no_letters_no_buckets(text):
    assert len(langid.buckets(text)) == 0
