import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from lexweave.operators import context, counting, matcher, phrases, splitting, vocab
from lexweave.sources import tables
from pyspark.sql import functions as F

#: Every delimiter, some that are none, and letters whose small forms depend on place or are longer.
ODD = " \t\n\x0b\f\r\x1c\x85  $*\"'-+=,;:«»{}()<>[]–“”‘’|.?¿!¡—…&ÂâE€ΑΣσİẞǅéÉKaAzZ09_😀"


def texts() -> list[str | None]:
    random.seed(4)
    made = ["".join(random.choices(ODD, k=random.randint(0, 60))) for _ in range(400)]
    made += ["".join(random.choices("ab .?\n", k=random.randint(0, 40))) for _ in range(200)]
    return [None, "", ".", " ", "\n", "a", "b", ".a", "a.", "¿", "a¿b", "ΑΣ.ΑΣ ΑΣ'Α ΟΔΟΣ", *made, "x" * 3000, "a b. " * 2000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(random.choice(["src", "trg"]), k, k % 3, t) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, "side string, doc long, day_idx int, text string").repartition(3)


def as_lists(found: tuple[np.ndarray, pa.ListArray]) -> list[tuple[int, list[str]]]:
    return list(zip(found[0].tolist(), found[1].to_pylist(), strict=True))


@pytest.mark.parametrize("split", ["word_sentences", "phrase_sentences"])
def test_texts_are_split_as_by_column_functions(spark, docs, split, monkeypatch):
    corpus = tables.corpus(docs)
    sents = vocab.sentence_tokens(corpus) if split == "word_sentences" else vocab.phrase_rows(corpus)
    rows = sents.orderBy("doc", "line_no", "sent_no").select("doc", "toks").collect()
    want = [(r.doc, [t for t in r.toks if t]) for r in rows]
    whole = pa.array(texts(), pa.string())
    assert as_lists(getattr(splitting, split)(whole)) == want
    assert [(r + 7, t) for r, t in as_lists(getattr(splitting, split)(whole.slice(7)))] == [w for w in want if w[0] >= 7]
    monkeypatch.setattr(splitting, "SLICE", 100)
    name = {v.__name__: k for k, v in splitting.SPLITS.items()}[split]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(whole))), whole], ["doc", name])
    got = [(d, t) for b in splitting.sentences(iter([batch]), ["doc", name]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert got == want


def test_small_letters_are_those_of_spark(spark):
    every = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(k, "a" + c + "b " + c) for k, c in enumerate(every)], "k int, w string").select("k", F.lower("w").alias("w")).collect()
    assert splitting.lower(pa.array(["a" + c + "b " + c for c in every])).to_pylist() == [r.w for r in sorted(rows, key=lambda r: r.k)]


def test_counts_of_texts_are_those_of_their_sentences(spark, docs):
    def rows(df):
        return sorted(map(tuple, df.collect()))

    sents, phrase_rows = vocab.sentence_tokens(tables.corpus(docs)), vocab.phrase_rows(tables.corpus(docs))
    assert rows(counting.count_words(docs, "side", "day_idx")) == rows(counting.count_words(sents, "side", "day_idx"))
    words = spark.createDataFrame([("src", "a", 2), ("src", "b", 3), ("trg", "z", 9)], "side string, stem string, n long")
    for positions in (False, True):
        got = rows(context.collect(docs, words, words, 2, 1, positions))
        assert got == rows(context.collect(sents, words, words, 2, 1, positions)) and got
    listed = spark.createDataFrame([("src", "a b."), ("src", "a"), ("trg", "a b"), ("trg", "b.")], "side string, phrase string")
    whole = docs.withColumnRenamed("text", "phrase_text")
    got = rows(phrases.collect_context(whole, listed, words, 3, 2, 1))
    assert got == rows(phrases.collect_context(phrase_rows, listed, words, 3, 2, 1)) and got
    assert rows(matcher.hit_counts(whole, matcher.trie_of(listed), 3, "side", "day_idx")) == rows(vocab.listed_spans(phrase_rows, listed, 3, "side", "day_idx").groupBy("side", "day_idx", "phrase", "n_tok").count())
    known = words.select("stem")
    assert rows(vocab.counts_of_known(whole, known, 3)) == rows(vocab.counts_of_known(phrase_rows, known, 3))


def test_positions_against_the_join(spark, docs, monkeypatch):
    sents = vocab.sentence_tokens(tables.corpus(docs))
    words = spark.createDataFrame([("src", "a", 2), ("src", "b", 3), ("trg", "z", 9)], "side string, stem string, n long")
    got = sorted(map(tuple, context.collect(docs, words, words, positions=True).collect()))
    monkeypatch.setattr(counting.sizes, "FEW", 1)
    assert got == sorted(map(tuple, context.collect(sents, words, words, positions=True).collect())) and got


def test_only_wanted_words_leave_a_task(spark, docs):
    words = spark.createDataFrame([("src", "a", 2), ("trg", "b", 3)], "side string, stem string, n long")
    wanted = counting.few_stems(words)
    assert {(r.side, r.stem) for r in counting.count_contexts(docs, words, 2, 2, wanted).collect()} == {("src", "a"), ("trg", "b")}
    assert {(r.side, r.stem) for r in counting.count_words(docs, "side", stems=wanted).collect()} == {("src", "a"), ("trg", "b")}


def test_a_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": range(4000), "lang": ["en", "fr"] * 2000, "text": [f"{k} " * 50 for k in range(4000)]}), tmp_path / "documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        sizes = [r["count"] for r in tables.texts(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(sizes) == 4000 and len(sizes) >= 4 and max(sizes) < 2000


def test_bins_make_only_the_rankings_that_are_asked_for(monkeypatch):
    from lexweave.plans import induction

    class Rows:
        def __getattr__(self, name):
            return lambda *args, **kw: self

    asked = []
    monkeypatch.setattr(induction, "RANKINGS", {n: (lambda j, n=n: asked.append(n) or Rows()) for n in induction.RANKINGS})
    monkeypatch.setattr(induction, "binned_sources", lambda *args: Rows())
    monkeypatch.setattr(induction, "F", Rows())
    assert list(induction.rankings_by_bin(Rows(), names=("context",))) == ["context"] and asked == ["context"]


def test_an_induction_filters_its_words_once(spark):
    from lexweave.plans.fixtures import Induction

    i = Induction(spark, "/root/testdata/sf0.001")
    j = i.of(i.sources, i.targets)
    assert i.vocab.is_cached and i.sources.is_cached and i.totals.is_cached
    assert j.vocab is i.vocab and j.dictionary is i.dictionary and j.totals is i.totals and j.context_words is i.context_words
    i.release()
    assert not (i.vocab.is_cached or i.sources.is_cached or i.totals.is_cached)
