"""Readers and sinks as queries: the driver's tables are written in each format and read back.

Each query has its SQL beside it, over the tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dicts as D
from ..operators import pages as PG
from ..operators import phrases as P
from ..operators import vocab as V
from ..sources import files, readers, sinks, tables
from . import pages
from .fixtures import Induction
from .oracle import BASE, PAGES, PROB, all_sql, share

START, END = date(2010, 1, 1), date(2010, 1, 31)


def _day() -> Column:
    return F.date_add(F.lit(START), F.pmod("doc_id", F.lit(30)).cast("int"))


def _written(spark: SparkSession, sf_dir: str, name: Column) -> str:
    """English documents as text files of the given names."""
    folder = files.scratch(spark)
    docs = tables.read(spark, sf_dir, "documents").where("lang = 'en' and text is not null and doc_id is not null")
    files.write_named(docs.select(name.alias("name"), F.col("text").alias("value")), folder)
    return folder


def _summed(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("side", "day_idx").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir, F.concat(F.pmod("doc_id", F.lit(4)).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit(".en")).otherwise(F.lit(".xx"))))
    return _summed(readers.open_corpus("dev", spark, folder, "src", r"\d+\.en"))


def _proceedings(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir, F.concat(F.lit("ep-"), F.date_format(_day(), "yy-MM-dd"), F.lit("-ch1.txt")))
    return _summed(readers.open_corpus("europarl", spark, folder, "src", START, END))


def _crawl_name() -> Column:
    return F.concat(F.date_format(_day(), "yyyy"), F.lit("/"), F.date_format(_day(), "yyyy-M-d"), F.lit(".txt"))


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(readers.open_corpus("crawls", spark, _written(spark, sf_dir, _crawl_name()), "src", date(2010, 1, 3), date(2010, 1, 20)))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("2010-1-4.",), ("2010-1-14.",)], "title string")
    return _summed(readers.open_corpus("crawls", spark, _written(spark, sf_dir, _crawl_name()), "src", START, END, titles=wanted))


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(readers.open_corpus("crawls", spark, _written(spark, sf_dir, _crawl_name()), "src", START, END, share=0.4))


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether English and French files have the same titles: all of them, and with a French file left out."""
    folder = files.scratch(spark)
    docs = tables.read(spark, sf_dir, "documents").where("lang in ('en', 'fr') and text is not null and doc_id is not null")
    files.write_named(docs.select(F.concat("lang", F.lit("/"), F.pmod("doc_id", F.lit(5)).cast("string"), F.lit("."), "lang").alias("name"), F.col("text").alias("value")), folder)
    src, trg = readers.plain(spark, f"{folder}/en", "src"), readers.plain(spark, f"{folder}/fr", "trg")
    fewer = trg.where(~F.col("doc").endswith("/3.fr"))
    return spark.createDataFrame([("all", readers.same_files(src, trg)), ("fewer", readers.same_files(src, fewer))], "files string, same boolean")


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("p/"), F.lpad(F.pmod("doc_id", F.lit(12)).cast("string"), 2, "0"), F.lit(".txt"))
    return _summed(readers.open_corpus("wikitemp", spark, _written(spark, sf_dir, name), "src"))


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files one, two and three levels down; the two upper levels are listed."""
    level = F.pmod("doc_id", F.lit(3))
    folder = _written(spark, sf_dir, F.concat(F.when(level == 1, F.lit("a/")).when(level == 2, F.lit("a/b/")).otherwise(F.lit("")), F.pmod("doc_id", F.lit(6)).cast("string"), F.lit(".txt")))
    return files.listed(spark, folder, 2).select(readers.name_of(F.col("path")).alias("name"))


def _induction(spark: SparkSession, sf_dir: str) -> Induction:
    return Induction(spark, sf_dir)


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.dictionary(_induction(spark, sf_dir).dictionary.select("src", "trg"), path := files.scratch(spark))
    return readers.dictionary(spark, path)


def _parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of files whose lines of one number belong together; their order is the dictionary's."""
    ranked, folder = _induction(spark, sf_dir).dictionary.repartitionByRange(5, "rn").sortWithinPartitions("rn"), files.scratch(spark)
    for side in ("src", "trg"):
        ranked.select(side).write.text(f"{folder}/{side}")
    return readers.parallel_dictionary(spark, f"{folder}/src", f"{folder}/trg")


def _probable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair stands twice; the later probability counts."""
    once = D.probabilistic(_induction(spark, sf_dir).dictionary)
    rows = once.withColumn("prob", F.explode(F.array(F.lit(0.01), F.col("prob")))).repartitionByRange(5, F.col("prob") != 0.01, "src")
    sinks.dictionary(rows.sortWithinPartitions(F.col("prob") != 0.01, "src"), path := files.scratch(spark))
    return readers.probabilistic_dictionary(spark, path)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("  "), F.initcap("src"), F.lit(" 12"))
    _induction(spark, sf_dir).dictionary.select(line.alias("value")).write.text(path := files.scratch(spark))
    return readers.word_list(spark, path)


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    _induction(spark, sf_dir).dictionary.select(F.concat_ws(" ", "src", "trg").alias("value")).write.text(path := files.scratch(spark))
    return readers.stop_words(spark, path, "src")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one, two and three tokens in zipped files; those of at most two are taken."""
    lines = F.explode(F.array(F.col("src"), F.concat_ws(" ", "src", "trg"), F.concat_ws(" ", "src", "trg", "src")))
    _induction(spark, sf_dir).dictionary.select(lines.alias("value")).write.option("compression", "gzip").text(path := files.scratch(spark))
    return readers.phrase_list(spark, path, 2)


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase table file, read, given a feature and written anew, and read again."""
    entries, folder = _induction(spark, sf_dir).dictionary, files.scratch(spark)
    line = F.concat_ws(" ||| ", F.concat_ws(" ", "src", "src"), "trg", F.lit("(0) ()"), F.lit("(0)"), F.lit("0.5 0.25 0.125 0.75 2.718"))
    entries.select(line.alias("value")).write.text(f"{folder}/given")
    read = readers.phrase_table(spark, f"{folder}/given")
    scored = read.withColumns({c: F.lit(0.5) for c in P.SLOTS if c not in read.columns})
    sinks.lines(scored, P.text_line("all", F.col("prefix")), f"{folder}/scored", "src", "trg")
    again = readers.phrase_table(spark, f"{folder}/scored")
    return again.select("src", "trg", F.to_json("fwd").alias("fwd"), F.to_json("bwd").alias("bwd"), "fe", "lex_fe", "ef", "lex_ef", "penalty")


def _xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = tables.page_versions(spark, sf_dir).select("url", "segment_id", "fetched", F.lit(None).cast("long").alias("modified"), F.lit("en").alias("lang"), pages.described(), PG.links_of(F.col("html")).alias("links"), "html").withColumnRenamed("html", "content")
    sinks.pages_xml(version, path := files.scratch(spark))
    return readers.pages_xml(spark, f"{path}/lang=en").select("url", F.col("segment_id").cast("long").alias("segment_id"), "fetched", "lang", F.md5("content").alias("content_md5"), pages.meta_text().alias("meta"), pages.links_text().alias("links"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl's segments as sequence files, written, read and built."""
    folder, records, read = files.scratch(spark), pages.crawl_records(spark, sf_dir), None
    for segment in range(3):
        for kind in ("fetch", "raw", "parse", "text"):
            sinks.crawl_sequences(records.where((F.col("segment_id") == segment) & (F.col("kind") == kind)), folder, str(segment), kind)
        rows = readers.crawl_sequences(spark, folder, str(segment))
        read = rows if read is None else read.unionByName(rows)
    return _built(read)


def _built(records: DataFrame) -> DataFrame:
    built = PG.build_versions(records)
    return built.select("url", F.col("segment_id").cast("long").alias("segment_id"), "fetched", "lang", "title", F.md5("content").alias("content_md5"), pages.meta_text().alias("meta"), pages.links_text().alias("links"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl's folders by segment and kind of record."""
    folder, records = files.scratch(spark), pages.crawl_records(spark, sf_dir)
    records.withColumn("segment", F.col("segment_id")).drop("segment_id").write.partitionBy("segment", "kind").json(f"{folder}/parts")
    for path in files.matching(spark, f"{folder}/parts/segment=*/kind=*"):
        segment, kind = (x.split("=")[1] for x in path.rsplit("/", 2)[1:])
        files.rename(spark, path, f"{folder}/segments/{segment}/{kind}")
    return _built(readers.crawl_chunks(spark, folder))


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, path = _induction(spark, sf_dir), files.scratch(spark)
    sinks.cache(V.prefix_classes(i.vocab), path)
    return sinks.cache(V.prefix_classes(i.vocab).limit(0), path).select("side", "stem", F.array_join("words", " ").alias("words"), "n")


def _by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"), "text")
    sinks.by_language(docs, path := files.scratch(spark))
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one folder: rows of even and of odd ids; every seventh row is rejected."""
    docs, path = tables.read(spark, sf_dir, "documents").where("lang is not null and text is not null and doc_id is not null"), files.scratch(spark)
    rows = docs.select("doc_id", "lang", F.year(_day()).alias("year"), _day().alias("day"), (F.col("doc_id") % 7 == 0).alias("rejected"), F.col("doc_id").alias("modified"), "text")
    for odd in (0, 1):
        sinks.dated_corpus(rows.where(F.col("doc_id") % 2 == odd), path)
    read = spark.read.text(f"{path}/days").select("lang", F.col("day").cast("string").alias("day"), "value")
    return read.groupBy("lang", "day").agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "files_plain": _plain,
    "files_proceedings": _proceedings,
    "files_crawl": _crawl,
    "files_crawl_titles": _titles,
    "files_crawl_sampled": _sampled,
    "files_aligned": _aligned,
    "files_as_bins": _bins,
    "files_by_depth": _depth,
    "file_dictionary": _dictionary,
    "file_parallel_dictionary": _parallel,
    "file_probabilistic_dictionary": _probable,
    "file_word_list": _words,
    "file_stop_words": _stops,
    "file_phrase_list": _phrases,
    "file_phrase_table": _table,
    "file_pages_xml": _xml,
    "files_crawl_segments": _segments,
    "files_crawl_sequences": _sequences,
    "file_class_cache": _cached,
    "files_by_language": _by_language,
    "files_dated_corpus": _dated,
}

_LINES = "WITH d AS (SELECT *, unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang = 'en')\n"
_SUMS = "count(*) AS lines, sum(length(line))::BIGINT AS chars FROM d"


def oracle_sql() -> dict[str, str]:
    shared = all_sql()
    on_dict = f"WITH {BASE}\n"
    clean = r"NOT regexp_matches(src, '[\d*,._]') AND NOT regexp_matches(trg, '[\d*,._]')"
    return {
        "files_plain": f"{_LINES}SELECT 'src' AS side, NULL::INT AS day_idx, {_SUMS} WHERE doc_id % 2 = 0 HAVING count(*) > 0",
        "files_proceedings": f"{_LINES}SELECT 'src' AS side, (doc_id % 30)::INT AS day_idx, {_SUMS} GROUP BY 2",
        "files_crawl": f"{_LINES}SELECT 'src' AS side, (doc_id % 30 - 2)::INT AS day_idx, {_SUMS} WHERE doc_id % 30 BETWEEN 2 AND 18 GROUP BY 2",
        "files_crawl_titles": f"{_LINES}SELECT 'src' AS side, (doc_id % 30)::INT AS day_idx, {_SUMS} WHERE doc_id % 30 IN (3, 13) GROUP BY 2",
        "files_crawl_sampled": f"""{_LINES}, t AS (SELECT *, (DATE '2010-01-01' + (doc_id % 30)::INT)::DATE AS day FROM d)
            SELECT 'src' AS side, (doc_id % 30)::INT AS day_idx, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM t WHERE {share("year(day) || '-' || month(day) || '-' || day(day) || '.'")} < 400000 GROUP BY 2""",
        "files_aligned": """WITH t AS (SELECT DISTINCT lang, doc_id % 5 AS title FROM documents WHERE lang IN ('en', 'fr')), k AS (SELECT title, count(*) AS n FROM t GROUP BY 1)
            SELECT 'all' AS files, min(n) = 2 AS same FROM k UNION ALL SELECT 'fewer', min(n) = 2 AND count(*) FILTER (title = 3) = 0 FROM k""",
        "files_as_bins": f"{_LINES}SELECT 'src' AS side, (dense_rank() OVER (ORDER BY doc_id % 12) - 1)::INT AS day_idx, {_SUMS} GROUP BY doc_id % 12",
        "files_by_depth": "SELECT DISTINCT (doc_id % 6)::VARCHAR || '.txt' AS name FROM documents WHERE lang = 'en' AND text IS NOT NULL AND doc_id % 3 < 2",
        "file_dictionary": f"{on_dict}SELECT DISTINCT src, trg FROM dict WHERE {clean}",
        "file_parallel_dictionary": f"{on_dict}SELECT DISTINCT src, trg FROM dict WHERE {clean}",
        "file_probabilistic_dictionary": f"{on_dict}{PROB.replace('pdict AS', 'pd AS').split('pproj')[0].rstrip().rstrip(',')}\nSELECT src, trg, prob FROM pd",
        "file_word_list": f"{on_dict}SELECT DISTINCT src AS stem FROM dict",
        "file_stop_words": f"{on_dict}SELECT 'src' AS side, src AS word FROM dict UNION SELECT 'src', trg FROM dict",
        "file_phrase_list": f"{on_dict}SELECT src AS phrase FROM dict UNION SELECT src || ' ' || trg FROM dict",
        "file_phrase_table": f"{on_dict}SELECT src || ' ' || src AS src, trg, '[[0],null]' AS fwd, '[[0]]' AS bwd, 0.5::DOUBLE AS fe, 0.25::DOUBLE AS lex_fe, 0.125::DOUBLE AS ef, 0.75::DOUBLE AS lex_ef, 2.718::DOUBLE AS penalty FROM dict",
        "file_pages_xml": f"WITH {PAGES} SELECT url, segment_id, fetched, 'en' AS lang, md5(html) AS content_md5, 'none=;size=' || length(html) || ',' || length(html) || ' characters' AS meta, links FROM pv",
        "files_crawl_segments": shared["pages_versions"],
        "files_crawl_sequences": shared["pages_versions"],
        "file_class_cache": shared["prefix_classes"],
        "files_by_language": "SELECT CASE WHEN doc_id % 5 <> 0 AND lang IS NOT NULL THEN lang ELSE 'none' END AS lang, count(*) AS pages, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1",
        "files_dated_corpus": "SELECT lang, day, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (SELECT lang, (DATE '2010-01-01' + (doc_id % 30)::INT)::DATE::VARCHAR AS day, unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang IS NOT NULL AND doc_id % 7 <> 0) GROUP BY 1, 2",
    }
