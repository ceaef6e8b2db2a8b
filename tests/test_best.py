import random

import numpy as np
import pyarrow as pa
import pytest
from lexweave.operators import best, edit, ranking, sizes
from lexweave.plans import induction
from lexweave.plans.fixtures import Induction
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_best_of_blocks_with_ties():
    random.seed(1)
    names = ["".join(random.choices("abé", k=5)) for _ in range(400)]
    names = sorted(set(names), key=lambda _: random.random())
    scores = np.round(np.random.default_rng(2).random((3, len(names))), 1)
    kept = best.Best(3, 7)
    kept.add(pa.array(names[:100]), *(np.arange(300) % 3, np.arange(300) // 3), scores[:, :100].T.ravel())
    kept.cut()
    kept.add(pa.array(names[100:]), *(np.arange(3 * (len(names) - 100)) % 3, np.arange(3 * (len(names) - 100)) // 3), scores[:, 100:].T.ravel())
    got = sorted(kept.rows(["x", "y", "z"]).to_pylist(), key=lambda r: (r["src"], -r["score"], r["trg"]))
    want = [(s, n, x) for i, s in enumerate("xyz") for x, n in sorted(zip(scores[i].tolist(), names, strict=True), key=lambda p: (-p[0], p[1]))[:7]]
    assert [tuple(r.values()) for r in got] == want


def test_edits_are_levenshtein_distances(spark):
    random.seed(3)
    words = ["", "é", "abc"] + ["".join(random.choices("abcé😀", k=random.randint(0, 9))) for _ in range(60)]
    codes, size = best.codes(words)
    df = spark.createDataFrame([(a, b) for a in words[:20] for b in words], "a string, b string").select(F.levenshtein("a", "b").alias("d"))
    assert [d for w in words[:20] for d in best.edits(best.codes([w])[0][0][: len(w)], codes, size).tolist()] == [r.d for r in df.collect()]


@pytest.mark.parametrize("keep", [1, 5])
def test_nearest_words_are_those_of_all_pairs_with_far_fewer_compared(spark, keep):
    random.seed(5)
    stem = ["".join(random.choices("etaoinshrdlu", k=random.randint(3, 10))) for _ in range(3000)]
    targets = spark.createDataFrame([(w,) for w in sorted(set(stem))], "stem string").repartition(4)
    sources = [w[:-1] + "a" for w in stem[:30]]
    counted = spark.sparkContext.accumulator(0)
    found = best.nearest_words([(w, w) for w in sources], targets.withColumn("word", F.col("stem")), keep, counted)
    every = edit.distance(edit.pairs(spark.createDataFrame([(w,) for w in set(sources)], "stem string"), targets))
    assert rows(ranking.rank(found.distinct(), keep, smaller_better=True)) == rows(ranking.rank(every, keep, smaller_better=True))
    counted = spark.sparkContext.accumulator(0)
    best.nearest_words([(w, w) for w in sources], targets.withColumn("word", F.col("stem")), keep, counted).count()
    assert 0 < counted.value < 0.4 * 30 * targets.count()


def test_rankings_by_blocks_are_those_by_joins(spark, monkeypatch):
    i = Induction(spark, SF)
    made = {n: rows(f(i)) for n, f in (("context", induction.context_ranking), ("time", induction.time_ranking), ("edit", induction.edit_ranking))}
    scorers = {n: rows(induction.context_ranking(i, n)) for n in ("binary", "s0", "s2", "s3", "tfidf")}
    plan = induction.time_ranking(i)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan
    i.release()
    monkeypatch.setattr(best, "MATRIX", 1)
    monkeypatch.setattr(sizes, "FEW", 1)
    j = Induction(spark, SF)
    assert made == {n: rows(f(j)) for n, f in (("context", induction.context_ranking), ("time", induction.time_ranking), ("edit", induction.edit_ranking))}
    assert scorers == {n: rows(induction.context_ranking(j, n)) for n in scorers}
    j.release()


def test_pair_times_are_those_of_all_pairs(spark):
    i = Induction(spark, SF)
    pairs = induction.context_ranking(i).select("src", "trg")
    assert rows(i.time_scores_of(pairs).select("src", "trg", "score")) == rows(i.time_scores.join(pairs, ["src", "trg"]).select("src", "trg", "score"))
    i.release()


def test_no_sources_and_no_targets(spark):
    vectors = spark.createDataFrame([("src", "a", "x", 1.0)], "side string, stem string, dim string, v double")
    assert best.best_products(vectors, best.source_matrix(vectors), 3).count() == 0
    none = vectors.where("side = 'trg'")
    assert best.best_products(vectors.withColumn("side", F.lit("trg")), best.source_matrix(none), 3).count() == 0
    words = spark.createDataFrame([("a", "a")], "stem string, word string")
    assert best.nearest_words([], words, 3).count() == 0 and best.nearest_words([("a", "a")], words.limit(0), 3).count() == 0
