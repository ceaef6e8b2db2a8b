"""Phrase tables: contexts and features of phrase pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import context as C
from . import matcher as M
from . import sizes, splitting
from .edit import product
from .sizes import held
from .vocab import listed_spans

PENALTY = 2.718
# Names and order of the feature slots, and the layouts that are written.
SLOTS = ("fe", "lex_fe", "ef", "lex_ef", "penalty", "ph_context", "ph_time", "lex_context", "lex_time", "lex_edit")
LAYOUTS = {
    "all": SLOTS,
    "phrase_lexical": ("penalty", "ph_context", "ph_time", "lex_context", "lex_time", "lex_edit"),
    "phrase": ("penalty", "ph_context", "ph_time"),
    "lexical": ("penalty", "lex_context", "lex_time", "lex_edit"),
    "none": ("penalty",),
}


def collect_context(rows: DataFrame, phrases: DataFrame, words: DataFrame, longest: int = 3, left: int = 2, right: int = 2) -> DataFrame:
    """(side, stem, ctx, ctx_n, corp_n) of listed phrases (side, phrase): the nearest words that end before or start after.

    rows: phrase_rows, or side and phrase_text, whole texts to split. Phrases and words that a task can hold are met where a
    sentence lies and counted there. Where they are too many, neighbours are cut from the array of a sentence, whose words lie
    inside white-space tokens (a few tokens suffice unless many hold no word), and occurrences and words are met in joins.
    """
    trie, listed = M.trie_of(phrases), [(r.side, r.stem) for r in words.select("side", "stem").distinct().limit(sizes.FEW + 1).collect()]
    if trie is not None and len(listed) <= sizes.FEW:
        near = M.near_words(rows.select("side", rows.columns[splitting.column(rows.columns)]), trie, longest, listed, left, right)
        known = words.select("side", F.col("stem").alias("ctx"), F.col("n").cast("double").alias("corp_n"))
        return near.join(F.broadcast(known), ["side", "ctx"]).select("side", "stem", "ctx", "ctx_n", "corp_n")
    key = ["side", "doc", "day_idx", "line_no", "sent_no"]
    reach = 4 * max(left, right) + 4
    size = F.size("inner")

    def before(pos: Column) -> Column:
        near = F.flatten(F.slice(F.col("inner"), F.greatest(pos - reach, F.lit(0)) + 1, F.least(pos, F.lit(reach))))
        some = F.when((F.size(near) >= left) | (pos <= reach), near).otherwise(F.flatten(F.slice(F.col("inner"), F.lit(1), pos)))
        return F.slice(some, F.greatest(F.size(some) - left, F.lit(0)) + 1, F.lit(left))

    def after(end: Column) -> Column:
        near = F.flatten(F.slice(F.col("inner"), end + 1, F.lit(reach)))
        some = F.when((F.size(near) >= right) | (size - end <= reach), near).otherwise(F.flatten(F.slice(F.col("inner"), end + 1, size)))
        return F.slice(some, F.lit(1), F.lit(right))

    inner = F.transform("toks", lambda t: F.filter(X.words(t), lambda w: w != ""))
    if trie is not None:
        found = M.open_hits(M.with_hits(rows.select("side", "toks"), trie, longest).withColumn("inner", inner), "side", "inner")
    else:
        found = listed_spans(rows, phrases, longest, *key).join(rows.select(*key, inner.alias("inner")), key)
    known = words.select("side", F.col("stem").alias("ctx"), F.col("n").alias("corp_n"))
    around = F.concat(before(F.col("pos")), after(F.col("pos") + F.col("n_tok")))
    pairs = found.select("side", F.col("phrase").alias("stem"), F.explode(around).alias("ctx")).join(held(known), ["side", "ctx"])
    return pairs.groupBy("side", "stem", "ctx").agg(F.count("*").cast("double").alias("ctx_n"), F.max("corp_n").cast("double").alias("corp_n"))


def all_pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """A table of every source with every target phrase."""
    return product(targets.select(F.col("phrase").alias("trg")), sources.select(F.col("phrase").alias("src")))


def subset(table: DataFrame, sources: DataFrame | None = None, targets: DataFrame | None = None, keep: bool = True) -> DataFrame:
    """Pairs whose source (and target, if given) is listed, or with keep=False is not."""
    how = "left_semi" if keep else "left_anti"
    if sources is not None:
        table = table.join(sources.select("src").distinct(), "src", how)
    return table if targets is None else table.join(targets.select("trg").distinct(), "trg", how)


def single_tokens(table: DataFrame, side: str = "src") -> DataFrame:
    return table.where(X.token_count(F.col(side)) == 1).select(side).distinct()


def targets_of(table: DataFrame, sources: DataFrame) -> DataFrame:
    return subset(table, sources).select("trg").distinct()


def links(table: DataFrame) -> DataFrame:
    """(src, trg, way, a, b): a row an alignment link, forward and backward, with the two tokens."""
    s, t = F.split("src", " "), F.split("trg", " ")
    ways = []
    for way, aligned, own, other in (("fwd", "fwd", s, t), ("bwd", "bwd", t, s)):
        opened = table.withColumns({"own": own, "other": other}).select("src", "trg", "own", "other", F.posexplode(aligned).alias("i", "js")).where("js is not null")
        each = opened.select("src", "trg", F.element_at("own", F.col("i") + 1).alias("x"), F.explode("js").alias("j"), "other").withColumn("y", F.element_at("other", F.col("j") + 1))
        a, b = ("x", "y") if way == "fwd" else ("y", "x")
        ways.append(each.select("src", "trg", F.lit(way).alias("way"), F.col(a).alias("a"), F.col(b).alias("b")))
    return ways[0].unionByName(ways[1])


def aligned_share(fwd: str = "fwd", bwd: str = "bwd") -> Column:
    """Aligned tokens over all tokens of both phrases."""
    def used(c: str) -> Column:
        return F.size(F.filter(F.col(c), lambda x: x.isNotNull()))
    return (used(fwd) + used(bwd)) / (F.size(F.split("src", " ")) + F.size(F.split("trg", " ")))


def lexical(table: DataFrame, listed: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    """(src, trg, name): mean token score over links between listed tokens, times the aligned share; null without a link.

    listed: (side, phrase); scores: (src, trg, score) of tokens, a missing pair scoring 0.
    """
    toks = {s: listed.where(F.col("side") == s).select("phrase").distinct() for s in ("src", "trg")}
    some = links(table).join(toks["src"].withColumnRenamed("phrase", "a"), "a", "left_semi").join(toks["trg"].withColumnRenamed("phrase", "b"), "b", "left_semi")
    scored = some.join(scores.select(F.col("src").alias("a"), F.col("trg").alias("b"), "score"), ["a", "b"], "left")
    mean = scored.groupBy("src", "trg").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    return table.join(mean, ["src", "trg"], "left").select("src", "trg", (F.col("mean") * aligned_share()).alias(name))


def lexical_edit(table: DataFrame, translit: DataFrame) -> DataFrame:
    """(src, trg, lex_edit): edits over all links by mean letters, unaligned letters counted; source tokens are
    transliterated first. translit: (src, trg), one a word."""
    made = links(table).join(translit.select(F.col("src").alias("a"), F.col("trg").alias("t")), "a", "left").withColumn("a", F.coalesce("t", "a"))
    sums = made.groupBy("src", "trg").agg(F.sum(F.levenshtein("a", "b")).cast("double").alias("edits"), F.sum((F.length("a") + F.length("b")) / 2.0).alias("letters"))

    def loose(column: str, aligned: str, side: str) -> DataFrame:
        opened = table.select("src", "trg", F.posexplode(aligned).alias("i", "js"), F.split(column, " ").alias("own")).where("js is null")
        words = opened.select("src", "trg", F.element_at("own", F.col("i") + 1).alias("a"))
        if side == "src":
            words = words.join(translit.select(F.col("src").alias("a"), F.col("trg").alias("t")), "a", "left").withColumn("a", F.coalesce("t", "a"))
        return words.groupBy("src", "trg").agg(F.sum(F.length("a")).cast("double").alias(f"loose_{side}"))

    zero = F.lit(0.0)
    joined = table.select("src", "trg").join(sums, ["src", "trg"], "left").join(loose("src", "fwd", "src"), ["src", "trg"], "left").join(loose("trg", "bwd", "trg"), ["src", "trg"], "left")
    a, b = F.coalesce("loose_src", zero), F.coalesce("loose_trg", zero)
    edits, letters = F.coalesce("edits", zero) + F.greatest(a, b), F.coalesce("letters", zero) + (a + b) / 2
    return joined.select("src", "trg", F.when(letters != 0, edits / letters).alias("lex_edit"))


def features(table: DataFrame, **named: DataFrame) -> DataFrame:
    """The table with a column for each named (src, trg, score); a missing score is 0."""
    for name, scores in named.items():
        table = table.join(scores.select("src", "trg", F.col("score").alias(name)), ["src", "trg"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return table


def text_line(layout: str, prefix: Column | None = None, digits: int | None = None) -> Column:
    """``src ||| trg ||| [prefix]features``; a missing feature is 0, a missing penalty its default."""
    def shown(slot: str) -> Column:
        value = F.coalesce(F.col(slot), F.lit(PENALTY)) if slot == "penalty" else F.col(slot)
        value = F.format_string(f"%.{digits}f", value) if digits is not None else value.cast("string")
        return F.coalesce(value, F.lit("0"))
    feats = F.concat_ws(" ", *(shown(s) for s in LAYOUTS[layout]))
    return F.concat_ws(" ||| ", "src", "trg", feats if prefix is None else F.concat(prefix, feats))


def context_sizes(table: DataFrame, wctx: DataFrame) -> DataFrame:
    """(src, trg, src_ctx, trg_ctx, shared): sizes of the contexts of each pair and of what they share."""
    src, trg = (wctx.where(F.col("side") == s).select(F.col("stem").alias(s), "ctx").distinct() for s in ("src", "trg"))
    shared = table.select("src", "trg").join(src, "src").join(trg, ["trg", "ctx"]).groupBy("src", "trg").agg(F.count("*").alias("shared"))
    sizes = [x.groupBy(s).agg(F.count("*").alias(f"{s}_ctx")) for s, x in (("src", src), ("trg", trg))]
    out = table.select("src", "trg").join(sizes[0], "src", "left").join(sizes[1], "trg", "left").join(shared, ["src", "trg"], "left")
    return out.select("src", "trg", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("src_ctx", "trg_ctx", "shared")))


def pair_context_scores(ctx: DataFrame, dictionary: DataFrame, totals: DataFrame, table: DataFrame) -> DataFrame:
    """Cosine of projected contexts for the pairs of a table only: the join starts from the pairs."""
    both = C.project(ctx, dictionary).unionByName(ctx.where("side = 'trg'").select("side", "stem", "ctx", "ctx_n", "corp_n"))
    return pair_cosine(C.weigh(both, totals, "idf").withColumnRenamed("ctx", "dim").withColumnRenamed("w", "v"), table)


def pair_cosine(vectors: DataFrame, table: DataFrame) -> DataFrame:
    """(src, trg, score): cosine of the pairs of a table; vectors: (side, stem, dim, v)."""
    src, trg = (vectors.where(F.col("side") == s).select(F.col("stem").alias(s), "dim", F.col("v").alias(f"v_{s}")) for s in ("src", "trg"))
    norms = [x.groupBy(s).agg(F.sqrt(F.sum(F.col(f"v_{s}") ** 2)).alias(f"n_{s}")) for s, x in (("src", src), ("trg", trg))]
    dots = table.select("src", "trg").join(src, "src").join(trg, ["trg", "dim"]).groupBy("src", "trg").agg(F.sum(F.col("v_src") * F.col("v_trg")).alias("dot"))
    joined = table.select("src", "trg").join(dots, ["src", "trg"], "left").join(norms[0], "src", "left").join(norms[1], "trg", "left")
    both = F.col("n_src") * F.col("n_trg")
    return joined.select("src", "trg", F.coalesce(F.when(both != 0, F.col("dot") / both), F.lit(0.0)).alias("score"))


def token_features(table: DataFrame) -> DataFrame:
    """Token pairs: lexical features are the phrase features, edit distance goes by mean length."""
    return table.withColumns({"lex_context": F.col("ph_context"), "lex_time": F.col("ph_time"), "lex_edit": F.levenshtein("src", "trg") / ((F.length("src") + F.length("trg")) / 2.0)})
