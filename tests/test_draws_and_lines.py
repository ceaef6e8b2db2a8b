import random

from lexweave.functions import draws
from lexweave.operators import pages, reorder
from lexweave.sources import readers
from pyspark.sql import functions as F


def test_lines_are_numbered_over_many_splits(spark, tmp_path):
    random.seed(8)
    lines = ["".join(random.choices("ab é\t", k=random.randint(0, 40))) for _ in range(5000)]
    folder = tmp_path / "parts"
    folder.mkdir()
    for k in range(3):
        with open(folder / f"part-{k}", "w", encoding="utf-8", newline="") as f:
            f.writelines(x + ("\r\n" if k == 1 else "\n") for x in lines[k * 1700 : (k + 1) * 1700])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        numbered = readers.numbered_lines(spark, f"file://{folder}")
        assert [(r.line_no, r.line) for r in numbered.orderBy("line_no").collect()] == list(enumerate(lines))
        assert spark.read.text(f"file://{folder}").rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_draws_keep_their_share_and_repeat(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    kept = {r.a for r in df.where(draws.drawn(0.3, "a", "b")).collect()}
    assert 1050 < len(kept) < 1350
    assert kept == {r.a for r in df.repartition(7).where(draws.drawn(0.3, "a", "b")).collect()}
    assert kept != {r.a for r in df.where(draws.drawn(0.3, "a", "b", seed=2)).collect()}
    assert df.where(draws.drawn(1.0, "a")).count() == 4000 and df.where(draws.drawn(0.0, "a")).count() == 0


def test_sampled_neighbours_are_some_of_them(spark):
    pctx = spark.createDataFrame([("src", f"p{k}", "before", "q", k) for k in range(400)], "side string, phrase string, rel string, ctx_phrase string, n long")
    some = reorder.sample(pctx, 0.5).collect()
    assert 150 < len(some) < 250 and set(some) <= set(pctx.collect())


def test_a_days_pages_stay_rows_and_languages_are_found_without_contents(spark):
    v = spark.createDataFrame([(f"u{k}", 1, k, None, "fr" if k % 3 else None, f" c{k % 4} ") for k in range(12)], "url string, segment_id int, fetched long, modified long, lang string, content string")
    day = pages.dated_corpus(v.withColumn("modified", F.lit(946684800000)))
    assert sorted(r.text for r in day.collect()) == ["c0", "c1", "c2", "c3"]
    later = v.withColumns({"lang": F.lit("xx"), "fetched": F.col("fetched") + 1})
    merged = {r.url: r.lang for r in pages.merge(v, later).collect()}
    assert merged == {f"u{k}": "fr" if k % 3 else "xx" for k in range(12)}
