import numpy as np
import corpus_pipeline
from lexweave.llm import langid, packing, quality, queries
from pyspark.sql import functions as F
from test_langid_minhash_quality import brute_components
from test_sharding_packing_bpe import pieces_hold

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert kept.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    good = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == good
    marked = {r.doc_id: r.label for r in labels.collect()}
    assert sum(i in good for i, q in marked.items() if q) >= 0.97 * sum(marked.values())
    assert sum(i not in good for i, q in marked.items() if not q) >= 0.9 * sum(1 - q for q in marked.values())

    told = corpus_pipeline.keep_language(spark, kept, SF)
    assert told.columns == columns and told.count() >= 0.99 * len(good)
    odd = spark.createDataFrame([(-5, "123 456 !!", "en", "s", 10), (-6, None, None, None, None)], docs.schema)
    assert {r.doc_id for r in corpus_pipeline.keep_language(spark, kept.unionByName(odd), SF).where("doc_id < 0").collect()} == set()

    single = corpus_pipeline.keep_distinct(spark, told, SF)
    assert single.columns == columns
    want = brute_components({r.doc_id: r.text for r in told.collect()}, 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_run_packs_what_is_kept(spark):
    encode = packing.encoder(queries.token_file("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, SF).withColumn("ids_crc32", F.crc32("ids")).collect()
    kept = {r.doc_id for r in rows}
    assert 0.5 * len(texts) < len(kept) < len(texts)
    pieces_hold(rows, {i: [*encode(texts[i]), 1] for i in kept})
    assert all(len(r.ids) == 4 * r.length and np.frombuffer(r.ids, "<u4").size == r.length for r in rows)


def test_stages_of_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", None, None, None), (None, "a b c d e f", "en", "s", 11), (3, None, None, None, None)], schema)
    out = corpus_pipeline.keep_distinct(spark, odd, SF)
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 3]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert langid.keep_identified(odd).count() == 4


def test_stages_keep_other_columns_whatever_their_names(spark):
    names = ["score", "label", "id", "n", "h", "kept", "component_id", "lang_pred", "set_key", "node", "x"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    long_one = spark.createDataFrame([(-1, "Long words and some more, " * 40_000, "en", "s", 1)], docs.schema)
    df = docs.unionByName(long_one)
    for k, name in enumerate(names):
        df = df.withColumn(name, F.lit(k))
    df = df.cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}
    assert corpus_pipeline.pack(spark, df, SF).where("doc_id = -1").count() > 1
