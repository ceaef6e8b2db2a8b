"""Hand-computed small inputs."""

import math
from datetime import datetime

import pytest
from lexweave.functions import dates, json, languages, text
from lexweave.operators import context, dicts, edit, lsh, pages, phrases, ranking, reorder, sizes, temporal, vocab
from lexweave.sources import readers
from pyspark.sql import functions as F


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def value(df, column):
    return df.select(column.alias("x")).first().x


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(("line", "want"), [(", a-b  c.", ["", "a", "b", "c"]), ("--", []), ("", []), ("l'été «x»", ["l", "été", "x"])])
def test_words(spark, line, want):
    assert value(one(spark, t=line), text.words(F.col("t"))) == want


def test_sentences(spark):
    df = one(spark, t="a b. c?d")
    assert value(df, text.sentences(F.col("t"))) == ["a b", " c", "d"]
    assert value(df, text.phrase_sentences(F.col("t"))) == ["a b.", " c?", "d"]
    assert value(df, text.sentences(F.col("t"), one_a_line=True)) == ["a b. c?d"]


def test_ngrams(spark):
    df = one(spark, t=["x", "y", "z"])
    assert [r.text for r in value(df, text.ngrams(F.col("t"), 2))] == ["x", "x y", "y", "y z", "z"]
    assert len(value(df, text.ngrams(F.col("t"), -1))) == 6


def test_alignments(spark):
    assert value(one(spark, t="(0) (1,2) ()"), text.alignment(F.col("t"))) == [[0], [1, 2], None]


def test_windows(spark):
    df = one(spark, t=["a", "b", "c", "d"])
    assert [(r.stem, r.around) for r in value(df, text.window_words(F.col("t"), 1, 2))] == [("a", ["b", "c"]), ("b", ["a", "c", "d"]), ("c", ["b", "d"]), ("d", ["c"])]
    assert value(df, text.window_words_at(F.col("t"), 1, 1))[1].around == ["a|s:-1", "c|s:1"]


def vocabulary(spark, *counts, side="src"):
    return spark.createDataFrame([(side, w, n) for w, n in counts], "side string, stem string, n long")


def test_filters(spark):
    v = vocabulary(spark, ("abc", 4), ("a1", 5), ("x.y", 6), ("été", 6), ("ab", 9))
    assert rows(vocab.keep_all(v, vocab.occurs(fewer_than=5)), "stem") == [("ab",), ("x.y",), ("été",)]
    assert rows(vocab.keep_all(v, vocab.not_garbage(), vocab.longer_than(2)), "stem") == [("abc",), ("été",)]
    assert rows(v.where(vocab.occurs(more_than=5)), "stem") == [("a1",), ("abc",)]
    stops = spark.createDataFrame([("src", "ab")], "side string, word string")
    assert ("ab",) not in rows(vocab.without_stop_words(v, stops), "stem")
    assert rows(vocab.without_most_frequent(v, 3), "stem") == [("a1",), ("abc",)]


def test_classes(spark):
    v = vocabulary(spark, ("walking", 1), ("walked", 2), ("nations", 3), ("national", 4))
    assert rows(vocab.prefix_classes(v), "stem", "common", "n") == [("natio", "nation", 7), ("walke", "walked", 2), ("walki", "walking", 1)]
    s = vocabulary(spark, ("reading", 1), ("heading", 2), ("ing", 5))
    assert rows(vocab.suffix_classes(s), "stem", "common", "n") == [("ading", "eading", 3), ("ing", "ing", 5)]


def distribution(spark, bins, side="src", stem="w"):
    return spark.createDataFrame([(side, stem, b, float(v)) for b, v in bins.items()], "side string, stem string, bin int, v double")


def test_time_windows(spark):
    assert rows(temporal.tumbling(distribution(spark, {0: 1, 1: 2, 5: 4}), 3), "bin", "v") == [(0, 3.0), (1, 4.0)]
    assert rows(temporal.sliding(distribution(spark, {0: 1, 1: 2, 3: 4}), 2), "bin", "v") == [(0, 3.0), (1, 2.0), (2, 4.0)]
    with pytest.raises(ValueError):
        temporal.tumbling(distribution(spark, {0: 1}), 0)
    assert rows(temporal.merge(distribution(spark, {0: 1, 1: 2}), distribution(spark, {1: 3})), "bin", "v") == [(0, 1.0), (1, 5.0)]
    assert temporal.uniform(spark.createDataFrame([("w",)], "stem string"), 4).count() == 4


def test_time_cosine(spark):
    both = distribution(spark, {0: 1, 1: 1}).unionByName(distribution(spark, {1: 1}, "trg", "t"))
    assert math.isclose(temporal.cosine(both).first().score, 1 / math.sqrt(2))


def vectors(spark, **sides):
    return spark.createDataFrame([(s, s, c, float(w)) for s, v in sides.items() for c, w in v.items()], "side string, stem string, ctx string, w double")


@pytest.mark.parametrize(("src", "trg", "kind", "want"), [
    ({"a": 1, "b": 2}, {"a": 2, "b": 1}, "cosine", 0.8),
    ({"a": 1, "b": 1}, {"a": 1, "c": 9}, "dice", 2 / 3),
    ({"a": 1, "b": 1}, {"a": 1, "c": 9}, "dice_cosine", 1 / (math.sqrt(2) * 3)),
    ({"a": 2, "b": 1}, {"a": 3}, "product", 6.0),
])
def test_context_scores(spark, src, trg, kind, want):
    assert math.isclose(context.score(vectors(spark, src=src, trg=trg), kind).first().score, want)


def test_weights_and_projection(spark):
    ctx = spark.createDataFrame([("src", "w", "a", 2.0, 5.0), ("src", "w", "b", 1.0, 5.0)], "side string, stem string, ctx string, ctx_n double, corp_n double")
    d = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "src string, trg string")
    totals = spark.createDataFrame([("src", 5)], "side string, max_n long")
    projected = context.project(ctx, d)
    assert projected.count() == 3
    assert rows(context.weigh(projected, totals), "ctx", "w") == [("x", 2.0), ("y", 1.0)]
    scaled = context.project(ctx, d.withColumn("prob", F.lit(0.5)))
    assert rows(scaled, "ctx", "ctx_n", "corp_n")[0] == ("x", 0.5, 2.5)


def sentence(spark, *toks, side="src"):
    return spark.createDataFrame([(side, 1, 0, 0, 0, list(toks))], "side string, doc long, day_idx int, line_no int, sent_no int, toks array<string>")


def test_context_counts(spark):
    v = vocabulary(spark, ("a", 2), ("b", 1), ("c", 1))
    got = context.collect(sentence(spark, "a", "b", "a", "c"), v.where("stem = 'a'"), v, 1, 1)
    assert rows(got, "ctx", "ctx_n", "corp_n") == [("b", 2.0, 1.0), ("c", 1.0, 1.0)]
    assert rows(context.prune(got, 1), "ctx") == [("b",)]
    at = context.collect(sentence(spark, "a", "b", "a", "c"), v.where("stem = 'a'"), v, 1, 1, positions=True)
    assert rows(at, "ctx") == [("b|s:-1",), ("b|s:1",), ("c|s:1",)]


def test_ranks_fusion_accuracy(spark):
    scores = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.5), ("s", "c", 0.2), ("s", "d", 0.1)], "src string, trg string, score double")
    r = ranking.rank(scores, 3)
    assert rows(r, "trg", "rk") == [("a", 1.5), ("b", 1.5), ("c", 3.0)]
    assert rows(ranking.rank(scores, 9, threshold=0.2), "trg") == [("a",), ("b",)]
    x = spark.createDataFrame([("s", "t", 1.0), ("s", "u", 2.0)], "src string, trg string, rk double")
    y = spark.createDataFrame([("s", "t", 4.0)], "src string, trg string, rk double")
    assert rows(ranking.fuse([x, y]), "trg", "score") == [("t", 0.625), ("u", 0.25)]
    listed = spark.createDataFrame([("p", f"x{k}", float(k)) for k in range(1, 9)] + [("q", f"x{k}", float(k)) for k in range(1, 9)] + [("z", "n", 1.0)], "src string, trg string, rk double")
    gold = spark.createDataFrame([("p", "x1"), ("q", "x7"), ("z", "g"), ("unlisted", "g")], "src string, trg string")
    assert rows(ranking.accuracy(listed, gold, (1, 5, 10)), "k", "accuracy", "in_dict") == [(1, 33.33, 3), (5, 33.33, 3), (10, 66.67, 3)]
    assert rows(ranking.best(r), "trg") == [("a",)]
    assert rows(ranking.within(r, 0.3, 1.0), "trg") == [("a",), ("b",)]
    dumped = ranking.dump(r, spark.createDataFrame([("s", "b")], "src string, trg string"))
    assert rows(dumped, "line") == [("* a b",), ("c",)]


def test_zero_scores_fill_short_rankings(spark):
    scores = spark.createDataFrame([("s", "b", 0.5)], "src string, trg string, score double")
    stems = spark.createDataFrame([("s",)], "stem string")
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    assert rows(ranking.fill_zeros(scores, stems, targets, 2), "trg", "score") == [("a", 0.0), ("b", 0.5), ("c", 0.0)]


def test_frequency_bins(spark):
    v = spark.createDataFrame([(f"w{k}", 100 - k) for k in range(11)], "stem string, n long")
    bins = ranking.frequency_bins(v, 2)
    assert rows(bins.groupBy("bin").count(), "bin", "count") == [(0, 5), (1, 5)]
    assert ranking.frequency_bins(v, 2, sample=4).count() == 4


def test_edit(spark):
    df = one(spark, src="kitten", trg="sitting")
    assert edit.distance(df).first().score == 3
    assert math.isclose(value(df, edit.per_letter(F.col("src"), F.col("trg"))), 3 / 6.5)
    assert value(one(spark, a=["ab", "b"], b=["ab"]), edit.class_distance(F.col("a"), F.col("b"))) == 0.5
    t = spark.createDataFrame([("été", "ete")], "src string, trg string")
    assert edit.translit_distance(spark.createDataFrame([("ete", "été"), ("été", "été")], "src string, trg string"), t).orderBy("src").first().score == 0


def test_dictionaries(spark):
    d = dicts.clean(spark.createDataFrame([("A ", "x"), ("a", "x"), ("b,c", "y"), ("d", "1")], "src string, trg string"))
    assert rows(d, "src", "trg") == [("a", "x")]
    three = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "src string, trg string")
    assert rows(dicts.prune(three, 2), "src") == [("b",)] and dicts.prune(three, -1).count() == 3
    probs = spark.createDataFrame([(1, "a", "x", 0.2), (2, "a", "x", 0.9)], "line_no int, src string, trg string, prob double")
    assert dicts.last_probability(probs).first().prob == 0.9
    parts = dicts.split(three, 0.5)
    assert sum(p.count() for p in parts) == 3
    v = vocabulary(spark, ("a", 3))
    assert dicts.resolve(three, v, need_target=False).count() == 2 and dicts.resolve(three, v).count() == 0


def table(spark, *pairs):
    return spark.createDataFrame(pairs, "src string, trg string, fwd array<array<int>>, bwd array<array<int>>")


def test_lexical_features(spark):
    t = table(spark, ("a b", "x", [[0], None], [[0]]))
    listed = spark.createDataFrame([("src", "a"), ("trg", "x")], "side string, phrase string")
    scores = spark.createDataFrame([("a", "x", 0.6)], "src string, trg string, score double")
    assert math.isclose(phrases.lexical(t, listed, scores, "f").first().f, 0.6 * 2 / 3)
    none = spark.createDataFrame([("src", "q")], "side string, phrase string")
    assert phrases.lexical(t, none, scores, "f").first().f is None
    translit = spark.createDataFrame([("zz", "z")], "src string, trg string")
    # a-x both ways: 2 edits over 2 letters; b unaligned: 1 more edit, half a letter
    assert math.isclose(phrases.lexical_edit(t, translit).first().lex_edit, 3 / 2.5)


def test_phrase_table_text(spark):
    lines = spark.createDataFrame([("A b ||| c ||| (0) () ||| (0) ||| 0.1 0.2 0.3 0.4",)], "value string")
    t = readers.parse_phrase_table(lines)
    r = t.first()
    assert (r.src, r.trg, r.fwd, r.bwd, r.fe, r.lex_ef, r.penalty) == ("a b", "c", [[0], None], [[0]], 0.1, 0.4, 2.718)
    full = t.withColumns({c: F.lit(None).cast("double") for c in ("ph_context", "ph_time", "lex_context", "lex_time", "lex_edit")})
    assert value(full, phrases.text_line("phrase", F.col("prefix"))) == "a b ||| c ||| (0) () ||| (0) ||| 2.718 0 0"


def test_phrase_context_takes_words_outside_the_phrase(spark):
    r = sentence(spark, "one,", "two", "-", "three", "four.")
    listed = spark.createDataFrame([("src", "two -")], "side string, phrase string")
    words = vocabulary(spark, ("one", 1), ("three", 2), ("four", 3), ("two", 1))
    got = phrases.collect_context(r, listed, words, 2, 2, 1)
    assert rows(got, "ctx", "ctx_n") == [("one", 1.0), ("three", 1.0)]


def test_phrase_order(spark):
    corpus = spark.createDataFrame([("trg", 1, 0, "a b  c x d")], "side string, doc long, line_no int, line string")
    listed = spark.createDataFrame([("trg", p) for p in ("a", "b", "a b", "c", "d")], "side string, phrase string")
    got = reorder.neighbours(reorder.occurrences(corpus, listed), gap=1)
    have = set(rows(got, "phrase", "rel", "ctx_phrase"))
    assert ("b", "before", "a") in have and ("a", "after", "b") in have
    assert ("c", "disc", "a b") in have  # two blanks are not adjacent
    assert ("d", "disc", "c") in have and not any(p == "c" and r == "before" for p, r, _ in have)
    assert not any(r == "disc" for _, r, _ in rows(reorder.neighbours(reorder.occurrences(corpus.withColumn("side", F.lit("src")), listed.withColumn("side", F.lit("src")))), "phrase", "rel", "ctx_phrase"))


def test_order_scores(spark):
    pctx = spark.createDataFrame([("src", "s", "before", "u", 1), ("trg", "t", "before", "v", 3), ("trg", "t", "after", "v", 1)], "side string, phrase string, rel string, ctx_phrase string, n long")
    t = spark.createDataFrame([("s", "t"), ("u", "v")], "src string, trg string")
    r = {x.src: x for x in reorder.scores(pctx, t).collect()}
    assert (r["s"].b_mono, r["s"].b_swap, r["s"].b_disc, r["s"].a_mono) == (0.75, 0.25, 0.0, None)
    lines = [x.x for x in reorder.scores(pctx, t).orderBy("src").select(reorder.text_line().alias("x")).collect()]
    assert lines == ["s ||| t ||| 0.75 0.25 0.0 0.333333 0.333333 0.333333", "u ||| v ||| 0.333333 0.333333 0.333333 0.333333 0.333333 0.333333"]
    counts = spark.createDataFrame([("trg", "v", 9)], "side string, phrase string, n long")
    assert reorder.prune(pctx, counts, 1).count() == 2
    assert reorder.sample(pctx, 1.0).count() == 3 and reorder.sample(pctx, 0.0).count() == 0


def test_signatures(spark):
    v = spark.createDataFrame([("src", "a", "f", 1.0), ("src", "a", "g", 2.0), ("trg", "b", "f", 1.0), ("trg", "b", "g", 2.0), ("trg", "c", "f", -1.0), ("trg", "c", "g", -2.0)], "side string, stem string, feature string, v double")
    sigs = {r.stem: r.sig for r in lsh.signatures(v).collect()}
    assert sigs["a"] == sigs["b"]
    assert value(one(spark, a=sigs["a"], b=sigs["b"]), lsh.similarity(F.col("a"), F.col("b"))) == 1.0
    assert value(one(spark, a=sigs["a"], b=sigs["c"]), lsh.similarity(F.col("a"), F.col("b"))) == 0.0
    half = one(spark, a=[-1, -1, 0, 0], b=[0, 0, 0, 0])
    assert value(half, lsh.similarity(F.col("a"), F.col("b"))) < 1e-9
    assert len(value(half, lsh.packed(F.col("a")))) == 32
    word, seed = "añb", lsh.seeds()[5]
    h = seed
    for c in word:
        h = (h * 33 + ord(c)) & 0xFFFFFFFF
    h = h - (1 << 32) if h >= 1 << 31 else h
    assert value(one(spark, f=word), lsh.places(F.col("f")))[5] == abs(h) % 100_000


@pytest.mark.parametrize(("html", "want"), [('<HTML foo lang="en">', "en"), ('<html lang="en-US">', None), ("<p>", None), ("<html lang = FR >", "fr")])
def test_html_language(spark, html, want):
    assert value(one(spark, h=html), languages.html_language(F.col("h"))) == want


@pytest.mark.parametrize(("url", "site", "lang", "date"), [
    ("http://www.bbc.co.uk/russian/international/080426_x.shtml", "bbc", "ru", "2008-04-26"),
    ("http://news.bbc.co.uk/hi/english/world/1.stm", "bbc", "en", None),
    ("http://www.bbc.co.uk/zhongwen/trad/x", "bbc", "zh-TW", None),
    ("http://www.bbc.co.uk/1/hi/x", "bbc", "en", None),
    ("http://www1.voanews.com/persian/news/afgh-2010-04-28-92307209.html", "voa", "fa", "2010-04-28"),
    ("http://www1.voanews.com/russian/Uzbek_2010_04_28-92316159.html", "voa", "ru", "2010-04-28"),
    ("http://www1.voanews.com/azerbaijani/Goldman-04-27-2010-92207809.html", "voa", "az", "2010-04-27"),
    ("http://www1.voanews.com/urdu/Thailand-Demonstrations-27Apr09-92201884.html", "voa", "ur", "2009-04-27"),
    ("http://lenta.ru/news/2010/04/28/regime/", "lenta", "ru", "2010-04-28"),
    ("http://example.com/russian/", None, None, None),
])
def test_urls(spark, url, site, lang, date):
    df = one(spark, u=url)
    assert value(df, languages.site(F.col("u"))) == site and value(df, languages.url_language(F.col("u"))) == lang
    got = value(df, dates.url_date(languages.site(F.col("u")), F.col("u")))
    assert (got and str(got.date())) == date


@pytest.mark.parametrize(("site", "lang", "content", "want"), [
    ("dw", "de", "Deutsche Welle | 12.07.2010", datetime(2010, 7, 12)),
    ("bbc", "en", "x 09:30 GMT, Thursday, 19 November 2009 y", datetime(2009, 11, 19, 9, 30)),
    ("bbc", "en", "Thursday, 11 November, 2004, 00:28 GMT", datetime(2004, 11, 11, 0, 28)),
    ("bbc", "en", "Saturday, 19 January 2008, 19:10 GMT", datetime(2008, 1, 19, 19, 10)),
    ("bbc", "ru", "воскресенье, 2 августа 2009 г., 15:57 GMT", datetime(2009, 8, 2, 15, 57)),
    ("bbc", "az", "x 11 Dekabr, 2008 - Published 16:28 GMT", datetime(2008, 12, 11, 16, 28)),
    ("bbc", "cy", "Dydd Gwener, 5 Mawrth, 2004, 20:35 GMT", datetime(2004, 3, 5, 20, 35)),
    ("bbc", "zh-CN", "2009年03月21日", datetime(2009, 3, 21)),
    ("voa", "fa", "9.5.10", datetime(2010, 5, 9)),
    ("atlas", "sk", "16. novembra 2009 13:00", datetime(2009, 11, 16, 13, 0)),
    ("inform", "kk", "08.04.2010 / 13:58", datetime(2010, 4, 8, 13, 58)),
    ("diena", "lv", "Svētdiena, 9. maijs (2010) 15:36", datetime(2010, 5, 9, 15, 36)),
    ("azatliq", "tt", "24.12.2009", datetime(2009, 12, 24)),
    ("azatliq", "tt", "34.12.2009", None),
    ("other", "en", "24.12.2009", None),
])
def test_content_dates(spark, site, lang, content, want):
    df = one(spark, s=site, l=lang, c=content)
    assert value(df, dates.content_date(F.col("s"), F.col("l"), F.col("c")).cast("string")) == (want and str(want))


def test_versions(spark):
    v = spark.createDataFrame([("u", 1, 5, None, "en", "same"), ("u", 2, 3, None, "en", "same"), ("u", 1, 9, None, "en", "new")], "url string, segment_id long, fetched long, modified long, lang string, content string")
    assert rows(pages.single_versions(v), "fetched", "content") == [(3, "same"), (9, "new")]
    filled = pages.merge(v.withColumn("lang", F.lit(None).cast("string")), v)
    assert {r.lang for r in filled.collect()} == {"en"} and filled.count() == 2
    assert pages.complete(v.withColumn("content", F.lit(""))).count() == 0
    props = spark.createDataFrame([("u", 1, "k", "b"), ("u", 0, "k", "a"), ("u", 1, "", "x"), ("u", 1, "m", "z")], "url string, dataset int, key string, value string")
    assert pages.page_properties(props).first().props == {"k": ["a"], "m": ["z"]}


def test_metadata(spark):
    df = one(spark, m={"a": ["x", ""], "": ["y"], "e": []})
    clean = df.select(pages.drop_empty(F.col("m")).alias("m"))
    assert clean.first().m == {"a": ["x"]}
    assert value(clean, pages.first_value(F.col("m"), "a")) == "x" and value(clean, pages.first_value(F.col("m"), "z")) is None
    assert value(clean, pages.add_value(F.col("m"), "a", F.lit("w"))) == {"a": ["x", "w"]}
    assert value(clean, pages.set_value(F.col("m"), "a", F.lit("w"))) == {"a": ["w"]}


def test_dated_corpus_rejects_other_years(spark):
    v = spark.createDataFrame([("u", "en", 946684800000, " a "), ("w", "en", 946684800000, "a"), ("x", "en", 1577836800000, "b"), ("y", None, 1, "c"), ("z", "en", 0, "d")], "url string, lang string, modified long, content string")
    assert rows(pages.dated_corpus(v), "year", "rejected", "text") == [(2000, False, "a"), (2020, True, "b")]


def test_json(spark):
    df = one(spark, j='{"a": {"b": 3}, "c": "x"}')
    assert value(df, json.opt(F.col("j"), "a.b", "int")) == 3 and value(df, json.opt(F.col("j"), "c", "int", 7)) == 7
    assert value(df, json.has(F.col("j"), "c")) and value(df, json.keys(F.col("j"))) == ["a", "c"]
    assert value(df, json.build(x=F.lit(1), y=F.lit(None).cast("string"))) == '{"x":1}'


@pytest.mark.parametrize("few", [0, 2, 4096])
def test_product_in_blocks_is_the_product(spark, monkeypatch, few):
    monkeypatch.setattr(sizes, "FEW", few)
    src, trg = (spark.createDataFrame([(f"{side}{k}",) for k in range(n)], "stem string") for side, n in (("s", 7), ("t", 9)))
    assert sorted(map(tuple, edit.pairs(src, trg).select("src", "trg").collect())) == [(f"s{i}", f"t{j}") for i in range(7) for j in range(9)]


@pytest.mark.parametrize("few", [0, 4096])
def test_contexts_and_scores_whatever_the_sides_size(spark, monkeypatch, few):
    monkeypatch.setattr(sizes, "FEW", few)
    monkeypatch.setattr(context, "FEW_ENTRIES", few)
    corpus = spark.createDataFrame([("src", 1, 0, 0, "a b, c. ...a c b! ", "x"), ("trg", 2, 0, 0, "u v w", "x")], "side string, doc long, day_idx int, line_no int, line string, extra string")
    words = spark.createDataFrame([("src", "b", 5), ("trg", "v", 7)], "side string, stem string, n long")
    near = context.collect(vocab.sentence_tokens(corpus), spark.createDataFrame([("src", "a"), ("trg", "u")], "side string, stem string"), words)
    assert rows(near, "side", "stem", "ctx", "ctx_n", "corp_n") == [("src", "a", "b", 2.0, 5.0), ("trg", "u", "v", 1.0, 7.0)]
    listed = spark.createDataFrame([("src", "a c")], "side string, phrase string")
    around = phrases.collect_context(vocab.phrase_rows(corpus), listed, words)
    assert rows(around, "stem", "ctx", "ctx_n") == [("a c", "b", 1.0)]
    vectors = spark.createDataFrame([("src", "a", "v", 3.0), ("src", "a", "w", 4.0), ("trg", "u", "v", 2.0), ("trg", "t", "z", 1.0)], "side string, stem string, ctx string, w double")
    assert rows(context.dot_products(vectors), "src", "trg", "dot", "shared_trg", "n_src", "n_trg") == [("a", "u", 6.0, 4.0, 25.0, 4.0)]


def test_words_and_sentences_at_the_ends(spark):
    lines = ["", ".", " ", ",a", "a.", "..a..b", "-"]
    assert [value(one(spark, t=t), text.words(F.col("t"))) for t in lines] == [[], [], [], ["", "a"], ["a"], ["", "a", "b"], []]
    assert [value(one(spark, t=t), text.sentences(F.col("t"))) for t in lines] == [[], [""], [" "], [",a"], ["a"], ["", "a", "b"], ["-"]]


def test_numbers_over_ranges(spark):
    v = spark.createDataFrame([(f"w{k:03}", k % 7) for k in range(200)], "stem string, n int").repartition(5)
    ranked, size = ranking.numbered(v, F.desc("n"), F.asc("stem"))
    want = sorted(((k % 7, f"w{k:03}") for k in range(200)), key=lambda x: (-x[0], x[1]))
    assert size == 200 and [(r.n, r.stem) for r in sorted(ranked.collect(), key=lambda r: r.rn)] == want
    assert sorted(r.rn for r in ranked.collect()) == list(range(1, 201))
    assert ranking.frequency_bins(v.limit(0), 4).count() == ranking.frequency_bins(v.limit(3), 4).count() == 0


def test_a_normalised_series_keeps_its_bins(spark):
    t = spark.createDataFrame([("a", 0, 1.0), ("a", 4, 3.0)], "stem string, bin int, v double")
    for rebin in (temporal.tumbling, temporal.sliding):
        assert rebin(t, 2).count() > 0
        with pytest.raises(ValueError):
            rebin(temporal.normalize(t).where("bin > 0"), 2)


def test_classes_with_context_and_time(spark):
    v = spark.createDataFrame([("src", "a", 3), ("src", "b", 2), ("trg", "a", 1)], "side string, stem string, n int")
    c = spark.createDataFrame([("src", "a", "x")], "side string, stem string, ctx string")
    t = spark.createDataFrame([("src", "b", 0, 0.0), ("trg", "a", 0, 1.0)], "side string, stem string, bin int, v double")
    assert [tuple(r) for r in vocab.with_context(v, c).collect()] == [("src", "a", 3)]
    assert [tuple(r) for r in vocab.with_time(v, t).collect()] == [("trg", "a", 1)]


def test_random_candidate_is_one_of_them_and_stays(spark):
    r = spark.createDataFrame([("a", f"t{k}", 1.0 / (k + 1), float(k)) for k in range(9)] + [("b", "u", 0.5, 1.0)], "src string, trg string, score double, rk double")
    drawn = [sorted(map(tuple, ranking.random_candidate(x, seed).collect())) for x in (r, r.repartition(5)) for seed in (1, 2, 3)]
    assert drawn[:3] == drawn[3:] and all(x[1] == ("b", "u", 0.5) for x in drawn) and len({x[0] for x in drawn}) > 1


def test_json_arrays(spark):
    df = spark.createDataFrame([("1", '"x"', "[]", "[1, 2]", '{"k": 1}', None)], "a string, b string, e string, l string, o string, n string")
    got = df.select(json.accumulate(F.col("a"), F.col("b")), json.accumulate(F.col("n"), F.col("b")), json.accumulate(F.col("n"), F.col("n")), json.append(F.col("e"), F.col("a")), json.append(F.col("l"), F.col("b")), json.append(F.col("n"), F.col("a")), json.append(F.col("o"), F.col("a"))).first()
    assert tuple(got) == ('[1,"x"]', '"x"', None, "[1]", '[1, 2,"x"]', "[1]", None)
