import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from lexweave.llm import lm, queries

SF = "/root/testdata/sf0.01"


def test_base_scores_and_held_out_gain(spark):
    docs = {r.doc_id: lm.words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    count = Counter(w for i, d in docs.items() if i not in held for w in [*d, lm.END])
    n, v = sum(count.values()), len(count)
    rows = queries.op1_lm(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        tokens = [*docs[r.doc_id], lm.END]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(tokens), sum(count[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        assert r.score < 0
    better = [r.score - r.base_score for r in rows if r.held_out]
    assert sum(better) > 0 and sum(x > 0 for x in better) > 0.7 * len(better)


def test_start_sample_is_found_in_many_tasks(spark):
    docs = spark.range(0, 4000, 1, 12).selectExpr("id AS doc_id", "concat('t', id) AS text")
    some = lm.start_sample(docs, 4000, 300)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and plan.index("Exchange SinglePartition") < plan.index("Filter") and some.rdd.getNumPartitions() == 1
    texts = [r.text for r in some.collect()]
    assert 200 < len(texts) < 400 and texts == [r.text for r in lm.start_sample(docs.repartition(5), 4000, 300).collect()]
    assert lm.start_sample(docs.unionByName(docs), 4000, 300).count() == 2 * len(texts)  # ties by hash: all or none


def small_model():
    top = [(f"w{i}".encode(), 300 - i) for i in range(150)]
    vocab = lm.vocabulary(top, 40, 500)
    model = lm.Gru(vocab, 3)
    rng = np.random.default_rng(1)
    for name, part in zip(model.NAMES, model.parts(), strict=True):
        setattr(model, name, (part + rng.normal(0, 0.3, part.shape)).astype(np.float32))
    return vocab, model


def plain_step(model, word, h):
    """The gated unit written out: states as columns."""
    k = lm.HIDDEN
    gx, gh = model.W[:, :-1] @ model.E[word].T + model.W[:, -1:], model.U @ h
    z, r = (1 / (1 + np.exp(gx[s] + gh[s])) for s in (slice(0, k), slice(k, 2 * k)))
    c = np.tanh(gx[2 * k :] + r * gh[2 * k :])
    return z * h + (1 - z) * c


def with_ones(states):
    return np.concatenate([states, np.ones_like(states[:1])])


def test_next_token_probabilities_add_up():
    vocab, model = small_model()
    state = np.random.default_rng(2).normal(0, 1, (lm.HIDDEN, 1)).astype(np.float32)
    all_targets = np.arange(vocab.size + 2)
    assert math.isclose(np.exp(model.log_probs(with_ones(np.repeat(state, len(all_targets), 1)), all_targets).astype(float)).sum(), 1, rel_tol=1e-4)


def test_gradients_against_differences():
    vocab, model = small_model()
    for name, part in zip(model.NAMES, model.parts(), strict=True):
        setattr(model, name, part.astype(np.float64))
    rng = np.random.default_rng(4)
    inputs, targets = rng.integers(0, vocab.size + 2, (5, 3)), rng.integers(-1, vocab.size + 2, (5, 3))
    h = rng.normal(0, 1, (lm.HIDDEN, 3))

    def loss():
        state, out = h, []
        for t in range(5):
            state = plain_step(model, inputs[t], state * (inputs[t] != model.n))
            out.append(state)
        there = np.flatnonzero(targets.ravel() >= 0)
        return -model.log_probs(with_ones(np.concatenate(out, 1)[:, there]), targets.ravel()[there]).mean()

    lm_float = np.float32
    np.float32 = np.float64  # the window in double precision, so that differences are sharp
    try:
        grads, _ = model.train_window(inputs, targets, h)
    finally:
        np.float32 = lm_float
    for name in model.NAMES:
        part = getattr(model, name)
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in part.shape)
            if name == "E":
                at = (int(inputs[rng.integers(0, 5), 0]), at[1])
            keep = part[at]
            part[at] = keep + 1e-5
            up = loss()
            part[at] = keep - 1e-5
            down = loss()
            part[at] = keep
            assert math.isclose((up - down) / 2e-5, grads[name][at], rel_tol=1e-3, abs_tol=1e-6), name


def test_document_scores_do_not_depend_on_company():
    vocab, model = small_model()
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, vocab.size + 2, n).astype(np.int32) for n in (0, 1, 700, 3, 70, 0, 2)]
    docs = [np.where(d == vocab.size, 0, d) for d in docs]
    together = lm.score(model, docs)
    alone = [lm.score(model, [d])[0] for d in docs]
    assert np.allclose(together, alone, rtol=1e-4)
    for d, total in zip(docs[:5], together, strict=False):  # token by token
        h, by_hand, last = np.zeros((lm.HIDDEN, 1), np.float32), 0.0, vocab.size
        for t in [*d, vocab.size]:
            h = plain_step(model, [last], h)
            by_hand += model.log_probs(with_ones(h), np.array([t]))[0]
            last = t
        assert math.isclose(by_hand, total, rel_tol=1e-3)


def test_split_words_is_words():
    texts = [None, "", "  ", "A b", " x\ty\x0b\x0cz\r\n", "\x1c a\x1db \u00a0É é", "end", "\n", "a" * 10, "İ K"]
    for rows in (texts, texts[3:7], texts[:2], []):
        column = pa.array([*texts[:2], *rows], pa.string()).slice(2)
        offsets, found = lm.split_words(column)
        got = [found.slice(a, b - a).to_pylist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [lm.words(t) for t in rows]


def test_a_very_long_text_among_short_ones_takes_room_for_its_tokens_alone():
    vocab, model = small_model()
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, vocab.size, n).astype(np.int32) for n in [200_000, *[10] * 600]]
    tracemalloc.start()
    scores = lm.score(model, docs)
    assert lm.train(model, docs, 0.004) == sum(map(len, docs)) + len(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(scores).all() and most < 100e6


def test_most_frequent_words_come_without_ties_cut(spark):
    counts = {"a": 10**12, "b": 5000, "c": 5000, "d": 7, "e": 7, "f": 7, "g": 1}
    df = spark.createDataFrame([(bytearray(w.encode()), n) for w, n in [*counts.items(), (" ", 9)]], "word binary, n long")
    for most, want in ((100, "abcdefg"), (6, "abcdef"), (5, "abc"), (3, "abc"), (2, "a"), (0, "")):
        assert [w for w, _ in lm.most_frequent(df, most)] == [x.encode() for x in want]


def test_scores_of_documents_against_plain_loops(spark, monkeypatch):
    """The score column from the fitted weights: softmax over classes, over the class's words, a share for other words."""
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{int(i)}" for i in rng.zipf(1.5, n) % 300) for n in rng.integers(0, 40, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted, learn = [], lm.learn
    monkeypatch.setattr(lm, "learn", lambda docs, vocab, n: fitted.append((learn(docs, vocab, n)[0], vocab)) or (fitted[-1][0], 0))
    have = {r.doc_id: r.score for r in lm.score_documents(df, learn_from=df.doc_id % 3 != 0, shortlist=50).collect()}
    model, vocab = fitted[0]
    count = Counter(w for i, t in enumerate(texts) if i % 3 for w in lm.words(t))
    own = {w: i for i, w in enumerate(vocab.words.to_pylist())}
    others = [w for w in count if w not in own]
    mass = sum(count[w] for w in others) + len(others) + 1
    for i, text in enumerate(texts):
        h, last, total = np.zeros((lm.HIDDEN, 1), np.float32), vocab.size, 0.0
        for w in [*lm.words(text), None]:
            target = vocab.size if w is None else own.get(w, vocab.size + 1)
            h = plain_step(model, [last], h)
            odds = [math.exp(float(x)) for x in (model.C @ with_ones(h))[:, 0]]
            c = int(model.class_ids[target])
            total += math.log10(odds[c] / sum(odds))
            if target < vocab.size:
                lo, hi = int(model.start[c]), int(model.start[c + 1])
                inside = [math.exp(float(x)) for x in (model.O[lo:hi] @ with_ones(h))[:, 0]]
                total += math.log10(inside[target - lo] / sum(inside))
            elif w is not None:
                total += math.log10((count[w] + 1) / mass)
            last = target
        assert math.isclose(total, have[i], rel_tol=1e-4, abs_tol=1e-4)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "A a b"), (3, "x " * 30000), (4, "</end>   é")]
    df = spark.createDataFrame([(*r, "z", 0.5) for r in rows], "doc_id long, text string, rare string, score double")
    out = lm.score_documents(df).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 1, 4, 4, 30001]
    assert all(r.n_known == r.n_tokens and np.isfinite(r.score) for r in out)
    assert lm.score_documents(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    unlearnt = lm.score_documents(df, learn_from=F.lit(False)).collect()
    assert {r.n_known for r in unlearnt} == {0} and {r.train_tokens for r in unlearnt} == {0}
    assert all(np.isfinite(r.score) and r.base_score == 0 for r in unlearnt)


def test_every_training_document_is_learnt_from(spark):
    rng = np.random.default_rng(6)
    docs = [" ".join(f"w{i}" for i in rng.integers(0, 90, n)) for n in rng.integers(0, 30, 1500)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    count = Counter(w for d in docs for w in lm.words(d))
    top = count.most_common(80)
    vocab = lm.vocabulary(top, len(docs), sum(count.values()) - sum(n for _, n in top))
    model, learnt = lm.learn(df, vocab, len(docs))
    assert learnt == sum(count.values()) + len(docs)
    assert all(np.isfinite(p).all() for p in model.parts())


def test_texts_are_split_once_for_training_and_scoring(spark, monkeypatch):
    df = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 23}" for j in range(k % 40))) for k in range(300)], "doc_id long, text string")
    seen, learn = [], lm.learn
    monkeypatch.setattr(lm, "learn", lambda docs, vocab, n: seen.append((docs, vocab)) or learn(docs, vocab, n))
    assert lm.score_documents(df, learn_from=df.doc_id % 3 != 0, shortlist=10).count() == 300
    docs, vocab = seen[0]
    assert "text" not in docs.columns and docs.count() == 200
    have = sorted(tuple(x) for x in lm.unpacked_ids(docs.select("ids").toArrow().column(0).combine_chunks(), vocab.kind))
    number = {w.as_py(): i for i, w in enumerate(vocab.words)}
    assert have == sorted(tuple(number.get(w, vocab.size + 1) for w in lm.words(r.text)) for r in df.where("doc_id % 3 <> 0").collect())
    apart = lm.with_ids(df.where("doc_id % 3 <> 0"), vocab)
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, docs.select("ids", "mark", "deal").collect()))


def test_large_logits_are_shifted():
    vocab = lm.vocabulary([(b"a", 5), (b"b", 4), (b"c", 3)], 2, 2)
    model = lm.Gru(vocab, 1)
    model.C[:, 0], model.O[:, 0] = [30 * k for k in range(len(model.C))], [100, 0, -100]
    assert model.wide()
    states = np.ones((lm.HIDDEN + 1, 5), np.float32)
    assert np.isfinite(model.log_probs(states, np.arange(5))).all()
    model.C[:, 0] = model.O[:, 0] = 0.5
    assert not model.wide()


def test_pieces_of_classes_add_up_and_windows_take_little_memory(monkeypatch):
    """What a window holds a token bounds the memory it runs through, which is most of its time: 2,259 bytes before."""
    model = lm.Gru(lm.vocabulary([(f"w{i}".encode(), 3000 - i) for i in range(2000)], 40, 500))
    rng = np.random.default_rng(3)
    ids, h = rng.integers(0, 2002, (16, 512)), np.zeros((lm.HIDDEN, 512), np.float32)
    model.O += rng.normal(0, 0.3, model.O.shape).astype(np.float32)
    grads, state = model.train_window(ids, np.roll(ids, -1), h)
    assert sum(x.nbytes for x in model.rooms.values()) < 1300 * ids.size
    logs = model.log_probs(with_ones(np.repeat(state, 2, 1)), ids[:2].ravel())
    monkeypatch.setattr(lm, "PIECE", 100)
    others, other_state = model.train_window(ids, np.roll(ids, -1), h)
    assert np.array_equal(state, other_state) and all(np.allclose(g, others[k], rtol=1e-3, atol=1e-7) for k, g in grads.items())
    assert np.allclose(logs, model.log_probs(with_ones(np.repeat(state, 2, 1)), ids[:2].ravel()), rtol=1e-4)
