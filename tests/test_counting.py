import random
from collections import Counter

import pytest
from lexweave.operators import context, counting, sizes, vocab


@pytest.fixture(scope="module")
def sents(spark):
    random.seed(9)
    rows = [(random.choice(["src", "trg", None]), random.randint(0, 3), random.choices(["", "a", "b", "c", "é", "zz"], k=random.randint(0, 9))) for _ in range(500)]
    rows[0] = ("src", None, ["a"])
    return spark.createDataFrame(rows, "side string, day_idx int, toks array<string>").repartition(3), rows


def test_words_are_counted_by_key(sents):
    df, rows = sents
    want = Counter((s, d, t) for s, d, toks in rows for t in toks if t)
    assert {(r.side, r.day_idx, r.stem): r.n for r in counting.count_words(df, "side", "day_idx").collect()} == want
    by_side = Counter((s, t) for s, _, toks in rows for t in toks if t)
    assert {(r.side, r.stem): r.n for r in vocab.word_counts(df).collect()} == by_side
    assert counting.count_words(df.limit(0), "side").count() == 0


@pytest.mark.parametrize(("left", "right"), [(2, 2), (1, 0), (0, 3)])
def test_contexts_against_a_loop_and_the_join(spark, sents, monkeypatch, left, right):
    df, rows = sents
    known = {("src", "a"), ("src", "é"), ("trg", "b"), ("trg", "zz")}
    words = spark.createDataFrame([(*k, 7) for k in sorted(known)], "side string, stem string, n long")
    stems = spark.createDataFrame([(s, t) for s in ("src", "trg") for t in ("a", "b", "é")], "side string, stem string")
    want = Counter((s, toks[i], toks[j]) for s, _, toks in rows for i in range(len(toks)) for j in range(max(0, i - left), min(len(toks), i + right + 1)) if i != j and (s, toks[j]) in known and toks[i] in "abé" and toks[i])
    def got():
        return {(r.side, r.stem, r.ctx): r.ctx_n for r in context.collect(df, stems, words, left, right).collect()}
    assert got() == want
    monkeypatch.setattr(sizes, "FEW", 1)
    assert got() == want


def test_contexts_without_words_or_sentences(spark, sents):
    df, _ = sents
    words = spark.createDataFrame([("src", "a", 1)], "side string, stem string, n long")
    assert context.collect(df, words, words.limit(0)).count() == 0 and context.collect(df.limit(0), words, words).count() == 0


def test_ngrams_are_counted_before_they_are_opened(spark):
    from lexweave.operators import vocab

    rows = [("src", ["a", "b", "a", "b", "a"]), ("trg", ["a", "b"]), ("src", ["é"]), ("src", []), ("trg", ["b", "a", "b", "c"])]
    df = spark.createDataFrame([(s, 1, 0, 0, k, t) for k, (s, t) in enumerate(rows)], "side string, doc long, day_idx int, line_no int, sent_no int, toks array<string>")
    for longest in (1, 3, 9, -1):
        want = sorted(tuple(r) for r in vocab.phrase_counts(vocab.spans(df.repartition(2), longest)).collect())
        counted = vocab.ngram_counts(df.coalesce(1), longest)
        assert sorted(tuple(r) for r in counted.collect()) == want
        if longest > 0:
            assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()
