"""Sentences, tokens, vocabularies and their filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.draws import order_of
from . import matcher as M
from . import splitting
from .counting import count_words
from .sizes import held


def sentence_tokens(corpus: DataFrame, one_a_line: bool = False, case_sensitive: bool = False) -> DataFrame:
    """(side, doc, day_idx, line_no, sent_no, toks): one row a sentence, its words in one array.

    Sentences without words are told by the text: a filter on the array would split each sentence a second time.
    """
    sents = corpus.select("side", "doc", "day_idx", "line_no", F.posexplode(X.sentences(F.col("line"), one_a_line)).alias("sent_no", "sent"))
    toks = F.transform(X.words(F.col("sent")), lambda t: X.word_form(t, case_sensitive))
    return sents.where(X.has_words(F.col("sent"))).select("side", "doc", "day_idx", "line_no", "sent_no", toks.alias("toks"))


def token_rows(sents: DataFrame, *columns: str) -> DataFrame:
    """The columns and stem: a row a word that isn't empty. Opening the bare array would have it made twice, for a filter."""
    return sents.select(*columns, F.explode(F.filter("toks", lambda t: t != "")).alias("stem"))


def word_counts(sents: DataFrame) -> DataFrame:
    """(side, stem, n)"""
    return count_words(sents, "side")


def not_garbage(word: str = "stem") -> Column:
    return ~F.col(word).rlike(X.GARBAGE) & ~F.col(word).rlike(X.DIGITS)


def all_words(words: str, test) -> Column:
    """A class passes if every word does."""
    return F.forall(F.col(words), test)


def longer_than(n: int, word: str = "stem") -> Column:
    return F.length(word) > n


def not_roman(word: str = "stem") -> Column:
    return ~F.col(word).rlike(X.ROMAN)


def occurs(fewer_than: int = -1, more_than: int = -1, n: str = "n") -> Column:
    """More often than ``fewer_than`` and not more often than ``more_than``; below 0 a bound is off. A missing count is 0."""
    count, out = F.coalesce(F.col(n), F.lit(0)), F.lit(True)
    if fewer_than >= 0:
        out = out & (count > fewer_than)
    if more_than >= 0:
        out = out & (count <= more_than)
    return out


def keep_all(df: DataFrame, *filters: Column) -> DataFrame:
    """A row stays if all filters accept it."""
    return df.where(reduce(lambda a, b: a & b, filters, F.lit(True)))


def without_stop_words(vocab: DataFrame, stop_words: DataFrame) -> DataFrame:
    return vocab.join(stop_words.select("side", F.col("word").alias("stem")), ["side", "stem"], "left_anti")


def with_context(vocab: DataFrame, context: DataFrame) -> DataFrame:
    """Classes that have a context: (side, stem) occurs in it."""
    return vocab.join(context.select("side", "stem").distinct(), ["side", "stem"], "left_semi")


def with_time(vocab: DataFrame, tdist: DataFrame) -> DataFrame:
    """Classes that have a time distribution with something in it."""
    return vocab.join(tdist.where("v > 0").select("side", "stem").distinct(), ["side", "stem"], "left_semi")


def by_count(n: str = "n", word: str = "stem"):
    return [F.desc(n), F.asc(word)]


def without_most_frequent(vocab: DataFrame, top: int) -> DataFrame:
    """Drops each side's ``top`` most frequent classes. The dropped ones are few and found without sorting the rest."""
    head = vocab.withColumn("rn", F.row_number().over(Window.partitionBy("side").orderBy(*by_count()))).where(F.col("rn") <= top).select("side", "stem")
    return vocab.join(head, ["side", "stem"], "left_anti")


def most_frequent(vocab: DataFrame, top: int) -> DataFrame:
    """Each side's ``top`` most frequent classes with their rank rn."""
    return vocab.withColumn("rn", F.row_number().over(Window.partitionBy("side").orderBy(*by_count()))).where(F.col("rn") <= top)


def hash_sample(vocab: DataFrame, top: int, seed: int = 1) -> DataFrame:
    """Each side's first ``top`` classes in an order that depends on the class and the seed alone."""
    order = [order_of("stem", seed=seed), F.asc("stem")]
    return vocab.withColumn("rn", F.row_number().over(Window.partitionBy("side").orderBy(*order))).where(F.col("rn") <= top).drop("rn")


def collect_vocabulary(sents: DataFrame, *filters: Column, most: int | None = None) -> DataFrame:
    """Distinct word forms that pass the filters, at most the first ``most`` by side and word."""
    found = keep_all(token_rows(sents, "side").distinct(), *filters)
    if most is None:
        return found
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("side").orderBy("stem"))).where(F.col("rn") <= most).drop("rn")


def simple_classes(vocab: DataFrame) -> DataFrame:
    return vocab.select("side", "stem", F.array("stem").alias("words"), "n")


def prefix_classes(vocab: DataFrame, size: int = 5) -> DataFrame:
    """Words that share their first ``size`` characters: (side, stem, words, common, n), common being their whole shared prefix."""
    return _classes(vocab, F.substring("stem", 1, size), lambda a, b: X.common_prefix(a, b), lambda w: w)


def suffix_classes(vocab: DataFrame, size: int = 5) -> DataFrame:
    """Words that share their last ``size`` characters; common is their whole shared suffix."""
    return _classes(vocab, F.right("stem", F.lit(size)), lambda a, b: F.reverse(X.common_prefix(a, b)), F.reverse)


def _classes(vocab: DataFrame, stem: Column, common, turn) -> DataFrame:
    key = turn(F.col("stem"))
    grouped = vocab.groupBy("side", stem.alias("class")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_set("stem")).alias("words"), F.min(key).alias("a"), F.max(key).alias("b"))
    return grouped.select("side", F.col("class").alias("stem"), "words", common(F.col("a"), F.col("b")).alias("common"), "n")


def count_totals(vocab: DataFrame) -> DataFrame:
    """(side, max_n, total_n): a row a side."""
    return vocab.groupBy("side").agg(F.max("n").alias("max_n"), F.sum("n").alias("total_n"))


def dictionary_coverage(vocab: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(types, covered_types, tokens, covered_tokens) of the source vocabulary by the dictionary."""
    src = vocab.where("side = 'src'").join(dictionary.select(F.col("src").alias("stem"), F.lit(1).alias("hit")).distinct(), "stem", "left")
    return src.agg(F.count("*").alias("types"), F.coalesce(F.sum("hit"), F.lit(0)).alias("covered_types"), F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("covered_tokens"))


def phrase_rows(corpus: DataFrame, one_a_line: bool = False) -> DataFrame:
    """(side, doc, day_idx, line_no, sent_no, sent, toks) for phrases: sentences keep their punctuation, tokens are lower-cased."""
    sents = corpus.select("side", "doc", "day_idx", "line_no", F.posexplode(X.phrase_sentences(F.col("line"), one_a_line)).alias("sent_no", "sent"))
    return sents.where(X.has_tokens(F.col("sent"))).withColumn("toks", F.transform(X.tokens(F.col("sent")), F.lower))


def spans(rows: DataFrame, longest: int, *carried: str) -> DataFrame:
    """Every n-gram occurrence: side, doc, day_idx, line_no, sent_no, further columns, pos, n_tok, phrase."""
    kept = ("side", "doc", "day_idx", "line_no", "sent_no", *carried)
    opened = rows.select(*kept, F.explode(X.ngrams(F.col("toks"), longest)).alias("g"))
    return opened.select(*kept, "g.pos", F.col("g.n").alias("n_tok"), F.col("g.text").alias("phrase"))


def listed_spans(rows: DataFrame, listed: DataFrame, longest: int, *kept: str) -> DataFrame:
    """Occurrences of listed phrases (side, phrase): the kept columns of phrase_rows (side among them), pos, n_tok, phrase.

    Phrases that a trie of bounded size holds are looked up where the sentences lie, and nothing but hits leaves them; of more
    phrases all n-grams are opened and meet them in a join.
    """
    if (trie := M.trie_of(listed)) is None:
        return spans(rows, longest).join(listed.select("side", "phrase"), ["side", "phrase"], "left_semi").select(*kept, "pos", "n_tok", "phrase")
    return M.open_hits(M.with_hits(rows.select(*kept, "toks"), trie, longest), *kept)


def counts_of_known(rows: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """(phrase, n_tok, n) of the n-grams of one side's sentences that hold none but listed words (stem).

    rows: toks, or phrase_text, whole texts to split, where the words are at most TRIE."""
    listed = [r.stem for r in words.select("stem").distinct().limit(M.TRIE + 1).collect()]
    if len(listed) <= M.TRIE:
        return M.word_spans(rows.select(rows.columns[splitting.column(rows.columns)]), sorted(listed), longest)
    counts = phrase_counts(spans(rows, longest))
    unknown = counts.select("phrase", F.explode(F.split("phrase", " ")).alias("stem")).join(words.select("stem").distinct(), "stem", "left_anti")
    return counts.join(unknown.select("phrase").distinct(), "phrase", "left_anti").select("phrase", "n_tok", "n")


def ngram_counts(rows: DataFrame, longest: int) -> DataFrame:
    """(side, phrase, n_tok, n) of all n-grams of phrase_rows; those of any length (below 0) are opened in rows."""
    return M.ngram_counts(rows, longest) if longest >= 0 else phrase_counts(spans(rows, longest))


def phrase_counts(found: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(side, phrase, n_tok, n) of n-grams, of listed (side, phrase) ones only if given."""
    rows = found if listed is None else found.join(held(listed.select("side", "phrase")), ["side", "phrase"], "left_semi")
    return rows.groupBy("side", "phrase", "n_tok").agg(F.count("*").alias("n"))


def classes_met(classes: DataFrame, some: DataFrame) -> DataFrame:
    """The classes (side, stem) that are also among ``some``."""
    return classes.join(some.select("side", "stem"), ["side", "stem"], "left_semi")
