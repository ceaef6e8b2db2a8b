"""Readers of corpora, dictionaries, phrase tables and pages. Paths may be in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.draws import drawn


def _lines(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8", recursive: bool = False, glob: str | None = None) -> DataFrame:
    """(path, line): path is that of the file."""
    reader = spark.read.option("encoding", encoding).option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def name_matches(regex: str, path: str = "path") -> Column:
    """The whole file name matches."""
    return name_of(F.col(path)).rlike(f"^(?:{regex})$")


def name_between(prefix: str = "", suffix: str = "", path: str = "path") -> Column:
    return name_of(F.col(path)).startswith(prefix) & name_of(F.col(path)).endswith(suffix)


def sampled(share: float, path: str = "path", seed: int = 1) -> Column:
    """A share of the files, decided by a hash of the title (the name less its last three characters), so that both
    languages keep the same titles."""
    name = name_of(F.col(path))
    title = F.substring(name, F.lit(1), F.length(name) - 3)
    return drawn(share, title, seed=seed)


def plain(spark: SparkSession, folder: str, side: str, regex: str = ".*", encoding: str = "UTF-8") -> DataFrame:
    """A flat folder of files whose names match: (side, doc, day_idx, line)."""
    return _lines(spark, folder, encoding).where(name_matches(regex)).select(F.lit(side).alias("side"), F.col("path").alias("doc"), F.lit(None).cast("int").alias("day_idx"), "line")


def _dated(lines: DataFrame, side: str, day: Column, start: date, end: date) -> DataFrame:
    """Days from start up to the day before end; start itself always counts."""
    rows = lines.withColumn("day", day).where((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(max(end, start + timedelta(days=1)))))
    return rows.select(F.lit(side).alias("side"), F.col("path").alias("doc"), F.datediff("day", F.lit(start)).alias("day_idx"), "line")


def proceedings(spark: SparkSession, folder: str, side: str, start: date, end: date, encoding: str = "UTF-8") -> DataFrame:
    """Files named ep-yy-MM-dd and anything after."""
    lines = _lines(spark, folder, encoding, glob="ep-*")
    return _dated(lines, side, F.to_date(F.try_to_timestamp(F.regexp_extract(name_of(F.col("path")), r"^ep-(\d\d-\d\d-\d\d)", 1), F.lit("yy-MM-dd"))), start, end)


def crawl(spark: SparkSession, folder: str, side: str, start: date, end: date, encoding: str = "UTF-8", share: float | None = None, titles: DataFrame | None = None) -> DataFrame:
    """Files <year>/<yyyy-M-d>.txt, each of its exact day; a share of them, or those whose titles (title) are given."""
    lines = _lines(spark, folder, encoding, recursive=True)
    if share is not None:
        lines = lines.where(sampled(share))
    if titles is not None:
        name = name_of(F.col("path"))
        lines = lines.withColumn("title", F.substring(name, F.lit(1), F.length(name) - 3)).join(titles.select("title").distinct(), "title", "left_semi")
    return _dated(lines, side, F.to_date(F.try_to_timestamp(F.regexp_extract(name_of(F.col("path")), r"^(\d{4}-\d{1,2}-\d{1,2})\.", 1), F.lit("yyyy-M-d"))), start, end)


def pages_as_bins(spark: SparkSession, folder: str, side: str, regex: str = ".*", encoding: str = "UTF-8") -> DataFrame:
    """Each file is a time bin, numbered in order of path. Only the list of files is ordered as a whole."""
    lines = _lines(spark, folder, encoding, recursive=True).where(name_matches(regex))
    files = lines.select("path").distinct().withColumn("day_idx", F.row_number().over(Window.orderBy("path")) - 1)
    return lines.join(files, "path").select(F.lit(side).alias("side"), F.col("path").alias("doc"), "day_idx", "line")


CORPORA: dict[str, Callable[..., DataFrame]] = {"europarl": proceedings, "wiki": plain, "wikitemp": pages_as_bins, "crawls": crawl, "dev": plain, "test": plain}


def open_corpus(kind: str, *args, **options) -> DataFrame:
    if kind not in CORPORA:
        raise ValueError(f"no corpus of kind {kind!r}; there are {', '.join(CORPORA)}")
    return CORPORA[kind](*args, **options)


def same_files(src: DataFrame, trg: DataFrame) -> bool:
    """Whether two corpora have files of the same titles."""
    titles = [x.select(F.regexp_replace(name_of(F.col("doc")), r"...$", "").alias("t")).distinct() for x in (src, trg)]
    return titles[0].join(titles[1].withColumn("hit", F.lit(1)), "t", "full").where("hit is null").isEmpty() and titles[1].join(titles[0], "t", "left_anti").isEmpty()


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(line_no, line) of a file, or of a folder's files by name, numbered in order from 0.

    Files are read in splits, as any other. A split's lines are counted where they are read, the counts, one a split, add up
    in order of file and place, and each line's place in its split makes its number.
    """
    lines = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
    split = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = lines.select(*(F.col(c).alias(a) for c, a in zip(split, ("file", "start"), strict=True)), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    sizes = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("file", "start", (before - F.col("first")).alias("shift"))
    return lines.join(offsets, ["file", "start"]).select((F.col("at") + F.col("shift")).alias("line_no"), "line")


def dictionary(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """(src, trg) of tab-separated files; cleaned unless raw."""
    from ..operators.dicts import clean

    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) >= 2).select(parts[0].alias("src"), parts[1].alias("trg"))
    return rows.distinct() if raw else clean(rows)


def parallel_dictionary(spark: SparkSession, src_path: str, trg_path: str) -> DataFrame:
    """(src, trg) of line i of either file."""
    from ..operators.dicts import clean, zip_lines

    return clean(zip_lines(numbered_lines(spark, src_path), numbered_lines(spark, trg_path)))


def probabilistic_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(src, trg, prob); the last probability of a pair counts."""
    from ..operators.dicts import last_probability

    parts = F.split("line", "\t")
    rows = numbered_lines(spark, path).where(F.size(parts) >= 3)
    return last_probability(rows.select("line_no", F.lower(F.trim(parts[0])).alias("src"), F.lower(F.trim(parts[1])).alias("trg"), parts[2].try_cast("double").alias("prob")))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(stem): the first token of each line."""
    return spark.read.text(path).select(F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1)).alias("stem")).where("stem <> ''").distinct()


def stop_words(spark: SparkSession, path: str, side: str) -> DataFrame:
    words = spark.read.text(path).select(F.explode(X.words(F.col("value"))).alias("w"))
    return words.select(F.lit(side).alias("side"), F.lower("w").alias("word")).where("word <> ''").distinct()


def phrase_list(spark: SparkSession, path: str, longest: int) -> DataFrame:
    """(phrase): distinct phrases of at most ``longest`` tokens, a line each; the file may be zipped."""
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("phrase")).where("phrase <> ''")
    return rows.where(X.token_count(F.col("phrase")) <= longest).distinct()


def parse_phrase_table(lines: DataFrame, column: str = "value") -> DataFrame:
    """(src, trg, fwd, bwd, prefix, fe .. ef, lex_ef, penalty) from lines ``src ||| trg ||| fwd ||| bwd ||| features``."""
    parts = F.split(column, r" \|\|\| ")
    feats = F.split(F.trim(F.get(parts, F.lit(4))), r"\s+")
    slots = {name: F.get(feats, F.lit(i)).try_cast("double").alias(name) for i, name in enumerate(("fe", "lex_fe", "ef", "lex_ef"))}
    penalty = F.coalesce(F.get(feats, F.lit(4)).try_cast("double"), F.lit(2.718)).alias("penalty")
    prefix = F.concat(F.get(parts, F.lit(2)), F.lit(" ||| "), F.get(parts, F.lit(3)), F.lit(" ||| ")).alias("prefix")
    return lines.select(F.lower(parts[0]).alias("src"), F.lower(parts[1]).alias("trg"), X.alignment(parts[2]).alias("fwd"), X.alignment(parts[3]).alias("bwd"), prefix, *slots.values(), penalty)


def phrase_table(spark: SparkSession, path: str) -> DataFrame:
    return parse_phrase_table(spark.read.text(path))


def pages_xml(spark: SparkSession, path: str) -> DataFrame:
    """(url, segment_id, fetched, modified, lang, content, meta, links) of <Page> elements; contents are decoded, what a
    version lacks of metadata and links is empty."""
    nested = "Metadata:array<struct<_key:string,Value:array<string>>>,Link:array<struct<_to:string,_anchor:string>>"
    schema = f"_URL string, _lang string, PageVersion array<struct<_segment:string,_fetched:bigint,_modified:bigint,ParsedContent:string,{nested}>>"
    pages = spark.read.format("xml").option("rowTag", "Page").schema(schema).load(path)
    one = pages.select(F.col("_URL").alias("url"), F.col("_lang").alias("lang"), F.explode("PageVersion").alias("v"))
    entries = F.transform("v.Metadata", lambda e: F.struct(e["_key"].alias("key"), e.Value.alias("value")))
    meta = F.map_from_entries(F.coalesce(entries, F.array().cast("array<struct<key:string,value:array<string>>>")))
    links = F.coalesce(F.transform("v.Link", lambda x: F.struct(x["_to"].alias("target"), F.coalesce(x["_anchor"], F.lit("")).alias("anchor"))), F.array().cast("array<struct<target:string,anchor:string>>"))
    return one.select("url", F.col("v._segment").alias("segment_id"), F.col("v._fetched").alias("fetched"), F.col("v._modified").alias("modified"), "lang", F.decode(F.unbase64("v.ParsedContent"), "UTF-8").alias("content"), meta.alias("meta"), links.alias("links"))


def crawl_chunks(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("fetch", "raw", "parse", "text")) -> DataFrame:
    """A crawl's records from <folder>/segments/<id>/<kind>/*.json, each kind to be left out at will."""
    from ..operators.pages import segment_of

    rows = spark.read.schema(RECORD).option("recursiveFileLookup", "true").json(f"{folder}/segments")
    path = F.col("_metadata.file_path")
    rows = rows.select("*", segment_of(path).alias("segment_id"), F.regexp_extract(path, r"/segments/[^/]+/([^/]+)/", 1).alias("kind"))
    return rows.where(F.col("kind").isin(*kinds))


#: Fields of a crawl's record; a kind of record has some of them, and those of one version share the number record, if any.
RECORD = "url string, record bigint, fetched bigint, modified bigint, html string, title string, content string, meta map<string,array<string>>, links array<struct<target:string,anchor:string>>"


def crawl_sequences(spark: SparkSession, folder: str, segment: str, kinds: tuple[str, ...] = ("fetch", "raw", "parse", "text")) -> DataFrame:
    """A segment's records from Hadoop sequence files <folder>/segments/<segment>/<kind>: address and record, both Text, the
    record as JSON. Each kind may be left out. No DataFrame source reads such files, so their pairs come from an RDD."""
    out = None
    for kind in kinds:
        pairs = spark.sparkContext.sequenceFile(f"{folder}/segments/{segment}/{kind}", "org.apache.hadoop.io.Text", "org.apache.hadoop.io.Text")
        rows = spark.createDataFrame(pairs, "url string, record string").select("url", F.from_json("record", RECORD).alias("r"))
        rows = rows.select("url", *(F.col(f"r.{c}") for c in ("record", "fetched", "modified", "html", "title", "content", "meta", "links")), F.lit(segment).alias("segment_id"), F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out
