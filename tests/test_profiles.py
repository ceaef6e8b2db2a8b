from collections import Counter

from lexweave.operators import detect, profiles
from lexweave.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def grams(text):
    """N-grams of one to three characters, most frequent first."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    t = f" {' '.join(words)} " if words else ""
    counts = Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1))
    return sorted(counts, key=lambda g: (-counts[g], g))


def test_profiles_against_plain_counts(spark):
    texts = {"x": ["Abba, baab!", "aß b1b", ""], "y": ["Été où? " * 30, "\n\t", "où où"], None: ["zzz"]}
    odd = ["abba", "où", "Été", None, "", "123", "é" * 5000, "abba"]
    learnt = profiles.learn(spark.createDataFrame([(k, t, 1) for k, ts in texts.items() for t in ts], "lang string, text string, gram int").repartition(3), size=9)
    got = profiles.tell(spark.createDataFrame([(i, "clash", t) for i, t in enumerate(odd)], "doc_id int, distance string, text string").drop("distance"), learnt, size=9)
    known = {}
    for lang in ("x", "y"):
        total = Counter()
        for t in texts[lang]:
            words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
            s = f" {' '.join(words)} " if words else ""
            total.update(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
        known[lang] = {g: r for r, g in enumerate(sorted(total, key=lambda g: (-total[g], g))[:9], 1)}
    want = {}
    for i, t in enumerate(odd):
        top = grams(t)[:9]
        far = sorted((sum(abs(p[g] - r) if g in p else 9 for r, g in enumerate(top, 1)), lang) for lang, p in known.items())
        want[i] = (far[0][1], far[0][0]) if top else (None, None)
    assert {r.doc_id: (r.lang, r.distance) for r in got.collect()} == want


def test_languages_of_unseen_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("true"))
    held = registry.queries()["lang_profiles"](spark, SF).join(docs, "doc_id").where("doc_id % 4 = 2 and lang is not null")
    right, n, sure, wrong = held.agg(F.sum(F.when(F.col("lang") == F.col("true"), 1)), F.count("*"), F.sum(F.col("reliable").cast("int")), F.sum(F.when(F.col("reliable") & (F.col("lang") != F.col("true")), 1).otherwise(0))).first()
    assert right >= 0.95 * n and sure >= 0.9 * n and wrong <= 0.02 * n


def test_pages_are_filled_by_what_is_learnt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = registry.queries()["page_languages_filled"](spark, SF)
    assert got.count() == 2 * docs.count()
    agree = got.join(docs.select(F.col("doc_id").cast("string").alias("url"), F.col("lang").alias("true")), "url").where("lang is not null").agg(F.avg(F.when(F.col("lang") == F.col("true"), 1.0).otherwise(0.0))).first()[0]
    assert agree > 0.97


def test_no_profiles_and_no_pages(spark):
    none = profiles.learn(spark.createDataFrame([], "lang string, text string"))
    assert [tuple(r) for r in profiles.tell(spark.createDataFrame([(1, "abc")], "doc_id int, text string"), none).collect()] == [(1, None, None, False)]
    versions = spark.createDataFrame([("u", None, 1, 1, "the of and to"), ("v", "fr", 1, 1, "the of and to")], "url string, lang string, segment_id int, fetched int, content string")
    assert {r.url: r.lang for r in detect.fill_language(versions).collect()} == {"u": "en", "v": "fr"}
    assert detect.fill_language(versions.limit(0)).count() == 0


def test_grams_of_long_texts_are_counted_in_parts_of_bounded_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    texts = [" abba baab ", "", " où été " * 40, " x ", "é" * 300]
    want = {(i, g): n for i, t in enumerate(texts) for g, n in Counter(t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)).items()}
    monkeypatch.setattr(profiles, "PART", 7)
    for dense in (1, 1 << 22):
        monkeypatch.setattr(profiles, "DENSE", dense)
        row, gram, n = profiles.count_grams(pa.array(texts))
        named = ["".join(chr(c) for c in ((g >> 42) & 0x1FFFFF, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF) if c) for g in gram.tolist()]
        assert dict(zip(zip(row.tolist(), named, strict=True), n.tolist(), strict=True)) == want and len(row) == len(want)
    assert [p.num_rows for p in profiles.parts(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), 0)] == [1, 1, 1, 1, 1]
    monkeypatch.undo()
    batch = pa.RecordBatch.from_arrays([pa.array([" some words of a text " * 150] * 4000)], ["t"])  # 13 million characters
    tracemalloc.start()
    for part in profiles.parts(batch, 0):
        profiles.count_grams(part.column(0))
    assert tracemalloc.get_traced_memory()[1] < 256 << 20
