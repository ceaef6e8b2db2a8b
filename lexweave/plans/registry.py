"""The registered queries of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import languages as L
from ..operators import context as C
from ..operators import detect
from ..operators import dicts as D
from ..operators import edit as E
from ..operators import lsh as S
from ..operators import pages as PG
from ..operators import phrases as P
from ..operators import profiles
from ..operators import ranking as R
from ..operators import reorder as O
from ..operators import temporal as T
from ..operators import vocab as V
from ..params import DEFAULTS, FULL, Params
from ..sources import tables
from . import induction, pages, phrase_scoring, round_trips
from .fixtures import Induction
from .oracle import all_sql, full_size


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best targets of the twenty most frequent source words by context."""
    return induction.context_ranking(Induction(spark, sf_dir))


#: Rankings that are also registered, as NAME_full, with the reference's sources and candidates.
_RANKINGS = ("rank_context", "rank_time", "rerank_time", "rank_dump", "accuracy_at_k")


_last: list[Induction] = []


def _fresh(spark: SparkSession, sf_dir: str, p: Params = DEFAULTS) -> Induction:
    """An induction for a query; what the query before has kept in memory goes."""
    while _last:
        _last.pop().release()
    _last.append(Induction(spark, sf_dir, p))
    return _last[-1]


def _on(step: Callable[[Induction], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: step(_fresh(spark, sf_dir))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _classes(df: DataFrame) -> DataFrame:
    return df.select("side", "stem", F.array_join("words", " ").alias("words"), "n")


def _sentence_split(i: Induction) -> DataFrame:
    return i.sents.groupBy("side", "doc", "line_no").agg(F.count("*").alias("sentences"), F.sum(F.size("toks")).alias("words"))


def _stop_words(i: Induction) -> DataFrame:
    stops = V.most_frequent(i.vocab, 50).select("side", F.col("stem").alias("word"))
    return V.without_stop_words(i.vocab.where(V.occurs(fewer_than=5)), stops).select("side", "stem", "n")


def _pruned(i: Induction) -> DataFrame:
    after = i.dictionary.select((F.col("rn") - 1).alias("rn"), F.col("trg").alias("next"))
    more = i.dictionary.where("rn % 3 = 0").join(after, "rn").select("src", F.col("next").alias("trg"))
    return D.prune(i.dictionary.select("src", "trg").unionByName(more), 2).groupBy("src").agg(F.count("*").alias("translations"))


def _sources(i: Induction) -> DataFrame:
    return i.sources.select(F.col("stem").alias("src"))


def _positions(i: Induction) -> DataFrame:
    return i.collected(i.sources, positions=True).select("side", "stem", "ctx", "ctx_n")


def _prob(i: Induction) -> DataFrame:
    return C.project(i.context, D.probabilistic(i.dictionary))


def _score_prob(i: Induction) -> DataFrame:
    return _rounded(C.score_by_name(i.context, D.probabilistic(i.dictionary), i.totals), "score")


def _rerank(i: Induction) -> DataFrame:
    ranking = induction.context_ranking(i)
    return R.rerank(ranking, i.time_scores_of(ranking.select("src", "trg")))


def _split(i: Induction) -> DataFrame:
    one, other = D.split(i.dictionary.select("src", "trg"), 0.3)
    return one.withColumn("part", F.lit("one")).unionByName(other.withColumn("part", F.lit("other")))


def _bins(i: Induction) -> DataFrame:
    return induction.binned_sources(i)


def _edit_pairs(i: Induction) -> DataFrame:
    return E.distance(E.pairs(i.sources, i.targets))


def _translit_pairs(i: Induction) -> DataFrame:
    return E.translit_distance(E.pairs(i.sources, i.targets), D.first_target(D.accents(i.vocab)))


def _token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(induction.score_token_pairs(spark, sf_dir).select("src", "trg", "lex_context", "lex_time", "lex_edit"), "lex_edit", digits=9)


def _given_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third dictionary word as a source, every second dictionary target as a candidate."""
    entries = Induction(spark, sf_dir).dictionary
    return induction.induce_lists(spark, sf_dir, entries.where("rn % 3 = 1").select(F.col("src").alias("stem")), entries.where("rn % 2 = 0").select(F.col("trg").alias("stem")))


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pages, two versions each, of which every third page knows its language; the others' is told by those."""
    docs = tables.read(spark, sf_dir, "documents")
    known = F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
    versions = docs.select(F.col("doc_id").cast("string").alias("url"), known.alias("lang"), "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("segment_id"))
    versions = versions.select("url", "lang", "segment_id", F.col("segment_id").alias("fetched"), F.when(F.col("segment_id") == 1, F.col("text")).otherwise(F.lit("")).alias("content"))
    learnt = docs.where("doc_id % 3 = 0").select("lang", "text")
    return detect.fill_language(versions, detect.by_profiles(learnt)).select("url", "segment_id", "lang")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by profiles of three quarters of them."""
    docs = tables.read(spark, sf_dir, "documents")
    told = profiles.tell(docs.select("doc_id", "text"), profiles.learn(docs.where("doc_id % 4 <> 2").select("lang", "text")))
    return told.select("doc_id", "lang", "distance", "reliable")


def _guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ways to put daily counts into other bins are refused, and how many bins the others give."""
    daily = tables.daily_events(spark, sf_dir)
    ready, out = T.normalize(daily), None
    for name, window, series, size in (("tumbling 3", T.tumbling, daily, 3), ("tumbling 0", T.tumbling, daily, 0), ("sliding -1", T.sliding, daily, -1), ("tumbling normalised", T.tumbling, ready, 3), ("sliding normalised", T.sliding, ready, 3)):
        try:
            bins = window(series, size).agg(F.count("*").alias("bins")).withColumn("refused", F.lit(False))
        except ValueError:
            bins = series.agg(F.count("*").alias("bins")).withColumn("refused", F.lit(True))
        row = bins.select(F.lit(name).alias("window"), "refused", "bins")
        out = row if out is None else out.unionByName(row)
    return out


def _time_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = tables.daily_events(spark, sf_dir).withColumn("stem", (F.col("stem").cast("long") % 10).cast("string"))
    early, late = daily.where("bin < 15"), daily.where("bin >= 10")
    return T.merge(early, late)


def _table_text(i: Induction) -> DataFrame:
    return phrase_scoring.scored_table(i).select(P.text_line("phrase_lexical", digits=6).alias("line"))


def _order_pruned(i: Induction) -> DataFrame:
    return O.prune(phrase_scoring.order_counts(i), V.phrase_counts(i.listed_spans), 3).select("side", "phrase", "rel", "ctx_phrase")


def _signature_bits(i: Induction) -> DataFrame:
    sigs = S.signatures(i.weighted.withColumnRenamed("ctx", "feature").withColumnRenamed("w", "v"))
    bit = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.getbit(F.element_at("sig", (F.floor(b / 64) + 1).cast("int")), b % 64).cast("string"))
    return sigs.select("side", "stem", F.array_join(bit, "").alias("bits"))


def _lsh_cosine(i: Induction) -> DataFrame:
    sigs = S.signatures(i.weighted.withColumnRenamed("ctx", "feature").withColumnRenamed("w", "v"))
    return _rounded(S.pair_scores(E.pairs(i.sources, i.targets), sigs), "score")


def _dumped(i: Induction) -> DataFrame:
    return phrase_scoring.signature_dump(i).withColumns({"context": F.hex("context"), "time": F.hex("time")})


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = PG.build_versions(pages.crawl_records(spark, sf_dir))
    return built.select("url", "segment_id", "fetched", "lang", "title", F.md5("content").alias("content_md5"), pages.meta_text().alias("meta"), pages.links_text().alias("links"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged versions with the links and the metadata of the pages at their address."""
    return PG.merge_pages(*pages.recrawled(spark, sf_dir)).select("url", "segment_id", "fetched", "lang", F.md5("content").alias("content_md5"), pages.meta_text("props").alias("props"), pages.links_text().alias("links"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language and moment's texts, in order and put together."""
    return PG.joined_digests(pages.prepare(pages.news_versions(spark, sf_dir)).withColumn("day", F.col("day").cast("string")))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = PG.out_links(tables.read(spark, sf_dir, "pages"))
    return found.groupBy("url").agg(F.count("*").alias("links"), F.countDistinct("target").alias("targets"))


def _detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = detect.function_word_detector(F.col("text"))
    return tables.read(spark, sf_dir, "documents").select("doc_id", told.alias("d")).select("doc_id", "d.lang", "d.reliable")


def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets of page properties; the first one's sizes stay, and only the second knows which pages came again."""
    page = tables.read(spark, sf_dir, "pages")
    again = F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string"))
    entries = [(0, "size", F.length("html").cast("string")), (1, "size", F.lit("0")), (1, "again", again), (1, "again", F.lit(""))]
    rows = page.select("url", F.explode(F.array(*(F.struct(F.lit(d).alias("dataset"), F.lit(k).alias("key"), v.alias("value")) for d, k, v in entries))).alias("e")).select("url", "e.*")
    return PG.page_properties(rows).select("url", F.explode("props").alias("key", "v")).select("url", "key", F.array_join("v", " ").alias("values"))


def _bbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses under several hosts and sections of the site, each marked."""
    host = F.element_at(F.array(*map(F.lit, ("http://www.bbc.co.uk/", "http://News.BBC.co.uk/", "http://bbc.co.uk/"))), (F.col("page_id") % 3 + 1).cast("int"))
    section = F.element_at(F.array(*map(F.lit, ("hi/english/", "english/", "local/", "2/", "russian/", "3/", "Low/English/"))), (F.col("page_id") % 7 + 1).cast("int"))
    url = F.concat(host, section, "page_id")
    return tables.read(spark, sf_dir, "pages").select("page_id", L.bbc_english(url).alias("english"))


def _classes_met(i: Induction) -> DataFrame:
    frequent = V.prefix_classes(i.vocab.where("n > 20"))
    return _classes(V.classes_met(V.prefix_classes(i.vocab), frequent))


def _topics(i: Induction) -> DataFrame:
    """Letters stand for topics."""
    letters = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.substring(c, k, F.lit(1)))
    return i.dictionary.select("src", "trg", C.common_topics(letters("src"), letters("trg")).cast("long").alias("common"))


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return tables.read(spark, sf_dir, "events").select("event_id", J.opt(props, "k", "bigint").alias("k"), J.opt(props, "missing", "bigint", -1).alias("missing"), J.build(id=F.col("event_id"), type=F.col("event_type")).alias("built"))


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events inside a tree of objects and arrays, read by path and kind; some values are missing or of another kind."""
    text = F.concat(F.lit('{"id":'), "event_id", F.lit(',"tags":["'), "event_type", F.lit('",null,'), F.col("event_id") % 7, F.lit('],"nest":{"props":'), "props", F.lit(',"on":true}}'))
    rows = tables.read(spark, sf_dir, "events").select("event_id", "event_type", J.parse(text).alias("t"))
    return rows.select(
        "event_id", J.get(F.col("t"), "nest.props.k", "bigint").alias("k"), J.get(F.col("t"), "tags[2]", "bigint").alias("tag"), J.get(F.col("t"), "nest.on", "boolean").alias("on"),
        J.get(F.col("t"), "nest.props", "bigint", -1).alias("wrong"), J.get(F.col("t"), "nest.none", "string", "-").alias("missing"), F.size(J.get(F.col("t"), "tags", "array<variant>")).alias("tags"),
        J.kind_of(F.col("t"), "tags[1]").alias("second"), J.kind_of(F.col("t"), "nest").alias("kind"), J.with_element(F.col("t"), "tags", J.parse(F.lit("[1]"))).alias("longer"),
    )


_ORDER = ("b_mono", "b_swap", "b_disc", "a_mono", "a_swap", "a_disc")

_STEPS: dict[str, Callable[[Induction], DataFrame]] = {
    "vocab_counts": lambda i: i.counts,
    "vocab_filtered": lambda i: i.vocab.where(V.occurs(fewer_than=5)),
    "vocab_native_script": lambda i: i.vocab.where(V.not_roman()),
    "vocab_without_stop_words": _stop_words,
    "prefix_classes": lambda i: _classes(V.prefix_classes(i.vocab)),
    "suffix_classes": lambda i: _classes(V.suffix_classes(i.vocab)),
    "classes_met": _classes_met,
    "common_topics": _topics,
    "max_token_counts": lambda i: i.totals,
    "sentence_split": _sentence_split,
    "phrase_sentences": lambda i: i.phrase_rows.groupBy("side", "doc").agg(F.count("*").alias("sentences"), F.sum(F.size("toks")).alias("tokens")),
    "ngrams": lambda i: V.ngram_counts(i.phrase_rows, i.p.ngram),
    "phrase_counts": lambda i: V.phrase_counts(i.listed_spans),
    "dict_resolved": lambda i: D.resolve(i.dictionary, i.vocab),
    "dict_pruned": _pruned,
    "dict_retain": lambda i: D.keep_sources(i.dictionary.select("src", "trg"), _sources(i)),
    "dict_remove": lambda i: D.keep_sources(i.dictionary.select("src", "trg"), _sources(i), keep=False),
    "dict_coverage": lambda i: V.dictionary_coverage(i.vocab, i.dictionary),
    "dict_identity": lambda i: D.identity_dictionary(i.vocab),
    "induction_sources": lambda i: i.sources.select("n", "stem"),
    "context_counts": lambda i: i.context,
    "context_positions": _positions,
    "context_pruned": lambda i: C.prune(i.context, 5).select("side", "stem", "ctx", "ctx_n"),
    "context_projected": lambda i: _rounded(i.weighted.where("side = 'src'").select("stem", "ctx", "w"), "w"),
    "context_projected_prob": lambda i: _rounded(_prob(i).select("stem", "ctx", "ctx_n", "corp_n"), "ctx_n", "corp_n"),
    "context_sizes": lambda i: P.context_sizes(i.table, C.project(i.phrase_context, i.dictionary.select("src", "trg")).select("side", "stem", "ctx").unionByName(i.phrase_context.where("side = 'trg'").select("side", "stem", "ctx"))),
    **{f"score_{n}": (lambda i, n=n: _rounded(i.raw_scores(n), "score")) for n in C.SCORERS},
    "score_s1_prob": _score_prob,
    "time_bins": lambda i: i.time,
    "time_align": lambda i: i.time.groupBy("side").agg(F.countDistinct("bin").alias("bins"), F.sum("v").alias("v")),
    "score_time_cosine": lambda i: _rounded(i.raw_time_scores, "score"),
    "score_edit": _edit_pairs,
    "score_edit_translit": _translit_pairs,
    "rank_context": induction.context_ranking,
    "rank_time": induction.time_ranking,
    "rank_edit": induction.edit_ranking,
    "rank_mrr": induction.fused_ranking,
    "accuracy_by_bin": lambda i: induction.accuracy_by_bin(i, ("context",)),
    "accuracy_by_bin_all": induction.accuracy_by_bin,
    "random_candidate": lambda i: R.random_candidate(induction.context_ranking(i)),
    "vocab_sampled": lambda i: V.hash_sample(i.vocab, 100).select("side", "stem", "n"),
    "dict_split": _split,
    "phrase_order_sampled": lambda i: O.sample(phrase_scoring.order_counts(i), 0.25),
    "phrase_targets": lambda i: P.targets_of(i.table, _sources(i)),
    "vocab_with_context": lambda i: V.with_context(i.vocab, i.context),
    "vocab_with_time": lambda i: V.with_time(i.vocab, i.time),
    "vocab_collected": lambda i: V.collect_vocabulary(i.sents, V.longer_than(i.p.min_length), most=1000),
    "vocab_without_top": lambda i: V.without_most_frequent(i.vocab, 30).where(V.occurs(fewer_than=5)).select("side", "stem", "n"),
    "context_pruned_by_corpus": lambda i: C.prune(i.context, 5, by="corp_n").select("side", "stem", "ctx", "corp_n"),
    "ranking_band": lambda i: R.within(induction.context_ranking(i), 0.2, 0.6),
    "rank_best": lambda i: R.best(induction.context_ranking(i)),
    "rerank_time": _rerank,
    "rank_dump": lambda i: R.dump(induction.context_ranking(i), i.dictionary),
    "accuracy_at_k": lambda i: R.accuracy(induction.context_ranking(i), i.dictionary, i.p.ks),
    "freq_bins": _bins,
    "freq_bands": lambda i: R.count_bands(i.vocab.where("side = 'src'"), 5, 105, 10),
    "phrase_table_subset": lambda i: P.subset(i.table, _sources(i)).select("src", "trg"),
    "phrase_single_tokens": lambda i: P.single_tokens(i.table),
    "phrase_context": lambda i: i.phrase_context,
    "phrase_time": lambda i: i.phrase_time,
    "phrase_features": lambda i: _rounded(phrase_scoring.phrase_features(i).select("src", "trg", "ph_context", "ph_time"), "ph_context", "ph_time"),
    "lex_features": lambda i: _rounded(phrase_scoring.lexical_features(i), "lex_context", "lex_time"),
    "lex_edit": lambda i: _rounded(P.lexical_edit(i.table, D.first_target(D.accents(i.vocab.where("side = 'src'")))), "lex_edit"),
    "phrase_table_text": _table_text,
    "phrase_order_counts": phrase_scoring.order_counts,
    "phrase_order_pruned": _order_pruned,
    "order_scores": lambda i: _rounded(phrase_scoring.order_scores(i), *_ORDER),
    "reordering_table_text": lambda i: phrase_scoring.order_scores(i).select(O.text_line(digits=8).alias("line")),
    "order_scores_lsh": lambda i: _rounded(S.order_scores(phrase_scoring.order_counts(i), i.table), *_ORDER),
    "lsh_signatures": _signature_bits,
    "lsh_cosine": _lsh_cosine,
    "signature_dump": _dumped,
}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rank_by_bin": induction.by_frequency,
    "score_tokens": _token_scores,
    "rank_given_lists": _given_lists,
    "page_languages_filled": _filled,
    "time_rebin_tumbling": lambda s, d: T.tumbling(tables.daily_events(s, d), 3),
    "time_rebin_sliding": lambda s, d: T.sliding(tables.daily_events(s, d), 3),
    "time_guards": _guards,
    "time_normalized": lambda s, d: _rounded(T.normalize(tables.daily_events(s, d)), "v", digits=9),
    "time_merge": _time_merge,
    "pages_versions": _versions,
    "pages_merge": _merged,
    "page_properties": _properties,
    "page_html_lang": lambda s, d: tables.read(s, d, "pages").select("url", L.html_language(F.col("html")).alias("lang")),
    "page_url_lang": lambda s, d: pages.news_versions(s, d).select("url", L.url_language(F.col("url")).alias("lang")),
    "page_bbc_english": _bbc,
    "page_dates": lambda s, d: PG.language_and_date(pages.news_versions(s, d)).select("url", "lang", "modified"),
    "dated_corpus": _dated,
    "lang_stats": lambda s, d: PG.language_statistics(PG.language_and_date(pages.news_versions(s, d))),
    "page_links": _links,
    "lang_detect": _detect,
    "lang_profiles": _profiles,
    "json_fields": _json,
    "json_trees": _trees,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    full = {f"{name}_full": (lambda s, d, step=_STEPS[name]: step(_fresh(s, d, FULL))) for name in _RANKINGS}
    full["accuracy_by_bin_full"] = lambda s, d: induction.accuracy_by_bin(_fresh(s, d, FULL))
    full["rank_edit_full"] = lambda s, d: induction.edit_ranking(_fresh(s, d, FULL))
    full["rank_mrr_full"] = lambda s, d: induction.fused_ranking(_fresh(s, d, FULL))
    full["rank_by_bin_full"] = lambda s, d: induction.by_frequency(s, d, p=FULL)
    return {name: _on(step) for name, step in _STEPS.items()} | _QUERIES | round_trips.QUERIES | full


def oracle_sql() -> dict[str, str]:
    shared = all_sql()
    twins = {f"{n}_full": shared[n] for n in (*_RANKINGS, "rank_edit", "rank_mrr", "rank_by_bin")} | {"accuracy_by_bin_full": shared["accuracy_by_bin_all"]}
    return shared | round_trips.oracle_sql() | {n: full_size(q, FULL.sources, FULL.keep) for n, q in twins.items()}
