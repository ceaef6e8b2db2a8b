import random
from collections import Counter

import pytest
from lexweave.operators import matcher, phrases, reorder, vocab

SCHEMA = "side string, doc long, day_idx int, line_no int, line string"


def tuples(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(4)
    words = ["a", "b", "c", "d", "B", "x-y", "é", "-"]
    lines = [(random.choice(["src", "trg"]), d, d % 3, 0, random.choice(["", " "]).join(random.choice(words) + random.choice([" ", " ", "  ", ". "]) for _ in range(random.randint(0, 14)))) for d in range(300)]
    return spark.createDataFrame(lines, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def listed(spark):
    some = ["a", "b", "a b", "b c d", "c", "d a", "a b c d", "é", "x-y b", "-", "nowhere", "b."]
    return spark.createDataFrame([(s, p) for s in ("src", "trg") for p in some if (s, p) != ("src", "c")], "side string, phrase string")


@pytest.mark.parametrize("longest", [1, 3, -1])
def test_hits_of_the_trie_are_those_of_the_join(corpus, listed, monkeypatch, longest):
    rows = vocab.phrase_rows(corpus)
    found = tuples(vocab.listed_spans(rows, listed, longest, "side", "doc", "sent_no"))
    monkeypatch.setattr(matcher, "TRIE", 1)
    assert found == tuples(vocab.listed_spans(rows, listed, longest, "side", "doc", "sent_no")) and found


def test_contexts_of_the_trie_are_those_of_the_join(spark, corpus, listed, monkeypatch):
    rows = vocab.phrase_rows(corpus)
    words = spark.createDataFrame([(s, w, 5) for s in ("src", "trg") for w in "abcxy"], "side string, stem string, n long")
    found = tuples(phrases.collect_context(rows, listed, words))
    monkeypatch.setattr(matcher, "TRIE", 1)
    assert found == tuples(phrases.collect_context(rows, listed, words)) and found


@pytest.mark.parametrize("longest_only", [True, False])
@pytest.mark.parametrize("gap", [0, 2])
def test_swept_neighbours_are_those_of_the_join(corpus, listed, monkeypatch, longest_only, gap):
    found = tuples(reorder.neighbour_counts(corpus, listed, 3, gap, longest_only))
    monkeypatch.setattr(matcher, "TRIE", 1)
    assert found == tuples(reorder.neighbour_counts(corpus, listed, 3, gap, longest_only)) and found


def test_no_neighbour_is_met_by_a_join(corpus, listed):
    plan = reorder.neighbour_counts(corpus, listed)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2  # the fixture's own, and that of the counts


def test_counts_of_known_words(spark, corpus, monkeypatch):
    rows = vocab.phrase_rows(corpus).where("side = 'src'")
    words = spark.createDataFrame([("a",), ("b",), ("é",), ("nowhere",)], "stem string")
    found = tuples(vocab.counts_of_known(rows, words, 3))
    monkeypatch.setattr(matcher, "TRIE", 1)
    assert found == tuples(vocab.counts_of_known(rows, words, 3)) and found


def test_empty_lists_and_sentences(spark, corpus, listed):
    rows = vocab.phrase_rows(corpus)
    assert vocab.listed_spans(rows, listed.limit(0), 3, "side").count() == 0
    assert vocab.listed_spans(rows.limit(0), listed, 3, "side").count() == 0
    assert reorder.neighbour_counts(corpus, listed.limit(0)).count() == 0
    assert reorder.neighbour_counts(corpus.limit(0), listed).count() == 0
    assert vocab.counts_of_known(rows, spark.createDataFrame([], "stem string"), 3).count() == 0


def test_only_hits_leave_the_sentences(corpus):
    trie = matcher.PhraseTrie([("src", "a b"), ("src", "a b c"), ("trg", "q")])
    found = matcher.with_hits(vocab.phrase_rows(corpus).select("side", "toks"), trie, -1).collect()
    for r in found:
        want = [(i, n, " ".join(r.toks[i : i + n])) for i in range(len(r.toks)) for n in (2, 3) if r.toks[i : i + n] == ["a", "b", "c"][:n]]
        assert r.side == "src" and [tuple(h) for h in r.hits] == want and want
