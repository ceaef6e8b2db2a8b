from lexweave.functions import json as J
from lexweave.operators import pages
from lexweave.sources import readers, sinks
from pyspark.sql import functions as F

VERSION = "url string, segment_id int, fetched long, modified long, lang string, content string, meta map<string,array<string>>, links array<struct<target:string,anchor:string>>"


def test_json_trees(spark):
    text = '{"a":[1,"x",{"b":null}],"n":{"t":2,"s":"é"},"z":"7"}'
    df = spark.createDataFrame([(text,), ("[1,2]",), ("{bad",), (None,)], "j string").select(J.parse(F.col("j")).alias("t"))

    def got(column):
        return [r.x for r in df.select(column.alias("x")).collect()]

    t = F.col("t")
    assert got(J.get(t, "a[0]", "bigint")) == [1, None, None, None]
    assert got(J.get(t, "n", "bigint", -1)) == [-1, -1, -1, -1]
    assert got(J.get(t, "z", "int")) == [7, None, None, None]
    assert got(F.size(J.get(t, "n", "map<string,variant>")))[0] == 2
    assert got(J.kind_of(t)) == ["OBJECT", "ARRAY", None, None]
    assert got(J.kind_of(t, "a[2].b")) == ["VOID", None, None, None] and got(J.kind_of(t, "none")) == [None] * 4
    assert got(J.with_element(t, "", J.parse(F.lit('{"q":1}')))) == [None, '[1,2,{"q":1}]', None, None]
    assert got(J.pretty(t))[0].split("\n")[2:4] == ['  "n" : {"s":"é","t":2},', '  "z" : "7"'] and got(J.pretty(t))[1:] == [None] * 3


def test_appending_to_json_arrays(spark):
    df = spark.createDataFrame([("[]",), ('[1, "a,]"]',), (None,), ("{}",), ("no",)], "j string")
    assert [r.x for r in df.select(J.append(F.col("j"), F.lit('{"b":[2]}')).alias("x")).collect()] == ['[{"b":[2]}]', '[1, "a,]",{"b":[2]}]', '[{"b":[2]}]', None, None]


def test_links_with_any_quotes_and_tags_inside(spark):
    html = """<A class=x HREF='/a b'>one <b>two</b></a><a data-href="no" href = "u?x=1">\n three </a><a href=plain>4</a><abbr href="no">5</abbr><a name="n">6</a><a href="">""</a>"""
    df = spark.createDataFrame([("p", html), ("q", None), ("r", "no links")], "url string, html string")
    assert [(r.url, r.link_no, r.target, r.anchor) for r in pages.out_links(df).collect()] == [("p", 0, "/a b", "one two"), ("p", 1, "u?x=1", "three"), ("p", 2, "plain", "4"), ("p", 3, "", '""')]


def test_versions_carry_metadata_and_links(spark, tmp_path):
    base = "url string, segment_id int, kind string, fetched long, modified long, html string, title string, content string, meta map<string,array<string>>, links array<struct<target:string,anchor:string>>"
    rows = [
        ("u", 1, "fetch", 5, None, None, None, None, None, None),
        ("u", 1, "raw", None, None, "<html lang=fr>", None, None, {"k": ["raw"], "empty": [""]}, None),
        ("u", 1, "parse", None, None, None, "T", None, {"k": ["parse"], "m": ["1", "2"]}, [("t", "a")]),
        ("u", 1, "text", None, None, None, None, "text", None, None),
        ("v", 1, "fetch", 6, None, None, None, None, None, None),
        ("v", 1, "text", None, None, None, None, "bare", None, None),
    ]
    built = pages.build_versions(spark.createDataFrame(rows, base).repartition(3))
    assert {r.url: (r.lang, r.meta, [tuple(x) for x in r.links]) for r in built.collect()} == {"u": ("fr", {"k": ["raw"], "m": ["1", "2"]}, [("t", "a")]), "v": (None, {}, [])}
    sinks.pages_xml(built.withColumn("lang", F.lit("en")), str(tmp_path / "xml"))
    back = readers.pages_xml(spark, str(tmp_path / "xml/lang=en"))
    assert {r.url: (r.content, r.meta, [tuple(x) for x in r.links]) for r in back.collect()} == {"u": ("text", {"k": ["raw"], "m": ["1", "2"]}, [("t", "a")]), "v": ("bare", {}, [])}


def test_first_seen_property_wins(spark):
    one = spark.createDataFrame([("u", 1, 9, None, None, "a", {"k": ["old"], "none": ["", None]}, []), ("u", 2, 8, None, None, "b", {"k": ["older"]}, [])], VERSION)
    two = spark.createDataFrame([("u", 1, 1, None, None, "c", {"k": ["new"], "n": ["2"]}, []), ("w", 1, 1, None, None, "c", None, [])], VERSION)
    assert {r.url: r.props for r in pages.merged_properties(one, two).collect()} == {"u": {"k": ["older"], "n": ["2"]}}


def test_sequence_files(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1, {"k": ["é", ""]}, [("t", "a")]), ("v\n", None, None, None)], "url string, fetched long, meta map<string,array<string>>, links array<struct<target:string,anchor:string>>")
    sinks.crawl_sequences(rows, f"file://{tmp_path}", "20100101", "raw")
    back = readers.crawl_sequences(spark, f"file://{tmp_path}", "20100101", kinds=("raw",))
    assert sorted((r.url, r.fetched, r.meta, r.links, r.segment_id, r.kind) for r in back.collect()) == [("u", 1, {"k": ["é", ""]}, [("t", "a")], "20100101", "raw"), ("v\n", None, None, None, "20100101", "raw")]


def test_pages_that_share_an_address_and_segment_stay_apart(spark, tmp_path):
    from collections import Counter

    from lexweave.plans import registry, round_trips

    html = '<html lang="%s"><title>t%d</title><a href="/%d">x</a> same %s</html>'
    rows = [(0, "u", html % ("en", 0, 0, "")), (3, "u", html % ("fr", 3, 3, "")), (6, "u", html % ("de", 6, 6, "more")), (1, "u", html % ("es", 1, 1, "")), (2, "v", html % ("en", 2, 2, "")), (4, "w", "<html>none</html>"), (5, "w", "<html>none</html>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    names = ("pages_versions", "files_crawl_segments", "files_crawl_sequences")
    for name in names:
        got = (registry.queries() | round_trips.QUERIES)[name](spark, str(tmp_path)).collect()
        assert sorted((r.url, r.fetched, r.title) for r in got) == sorted((url, 1000 * k, f"t{k}" if k < 4 or k == 6 else "") for k, url, _ in rows)
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in (*names, "pages_merge"):
        got = (registry.queries() | round_trips.QUERIES)[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({(registry.oracle_sql() | round_trips.oracle_sql())[name]})").fetchall()
        assert Counter(tuple(r) for r in got.collect()) == Counter(want), name


def test_a_moments_texts_are_put_together_in_order(spark, tmp_path):
    import hashlib

    from lexweave.plans import registry

    html = "<html lang=en><body>%s</body></html>"
    texts = {0: "b", 168: "a", 336: "b", 504: "é c", 3: "x", 8: "y"}  # a moment every 168 pages; 336 repeats a content
    spark.createDataFrame([(k, f"u{k}", html % t) for k, t in texts.items()], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.lang, r.day): r.text_md5 for r in registry.queries()["dated_corpus"](spark, str(tmp_path)).collect()}
    want = {("ru", "2008-01-01"): "a\nb\né c", ("ru", "2010-04-04"): "x", ("ru", "2008-09-09"): "y"}
    assert got == {k: hashlib.md5(t.encode()).hexdigest() for k, t in want.items()}
