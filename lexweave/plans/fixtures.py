"""Shared inputs of the registered queries, built from the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import best as B
from ..operators import context as C
from ..operators import dicts as D
from ..operators import edit as E
from ..operators import matcher as M
from ..operators import phrases as P
from ..operators import sizes
from ..operators import temporal as T
from ..operators import vocab as V
from ..params import DEFAULTS, Params
from ..sources import tables


@dataclass
class Induction:
    """The steps of lexicon induction over one folder of tables, each made when first asked for.

    What several steps read, counts and other aggregates far smaller than the corpus, is persisted: the corpus is read once
    for the counts and once for each property.
    """

    spark: SparkSession
    sf_dir: str
    p: Params = DEFAULTS

    def release(self) -> None:
        """Frees what is persisted; plans that still read it make it anew."""
        for made in self.__dict__.values():
            if isinstance(made, DataFrame) and made.is_cached:
                made.unpersist()

    def of(self, sources: DataFrame, targets: DataFrame) -> Induction:
        """The same induction of other words (side, stem, n), over what is made already and does not hang on them."""
        other = Induction(self.spark, self.sf_dir, self.p)
        for name in ("texts", "whole", "corpus", "sents", "counts", "vocab", "dictionary", "totals", "context_words"):
            other.__dict__[name] = getattr(self, name)
        other.__dict__["sources"], other.__dict__["targets"] = sources, targets
        return other

    @cached_property
    def texts(self) -> DataFrame:
        return tables.texts(self.spark, self.sf_dir, self.p.days)

    @cached_property
    def whole(self) -> DataFrame:
        """Texts for steps that split them themselves."""
        return self.texts.where("text is not null").withColumn("text", F.make_valid_utf8("text"))

    @cached_property
    def phrase_texts(self) -> DataFrame:
        return self.whole.withColumnRenamed("text", "phrase_text")

    @cached_property
    def corpus(self) -> DataFrame:
        return tables.corpus(self.texts)

    @cached_property
    def sents(self) -> DataFrame:
        return V.sentence_tokens(self.corpus)

    @cached_property
    def counts(self) -> DataFrame:
        return V.word_counts(self.whole)

    @cached_property
    def vocab(self) -> DataFrame:
        """Kept with its filters applied: an induction reads it some ten times, and the filters' expressions are most of such a read."""
        return V.keep_all(self.counts, V.not_garbage(), V.longer_than(self.p.min_length)).persist()

    @cached_property
    def dictionary(self) -> DataFrame:
        return D.rank_dictionary(self.vocab, self.p.dictionary).persist()

    @cached_property
    def totals(self) -> DataFrame:
        return V.count_totals(self.vocab).persist()

    @cached_property
    def sources(self) -> DataFrame:
        return V.most_frequent(self.vocab.where("side = 'src'"), self.p.sources).select("side", "stem", "n").persist()

    @cached_property
    def targets(self) -> DataFrame:
        return self.vocab.where(F.col("side") == "trg").where(V.occurs(fewer_than=self.p.fewer_than)).select("side", "stem", "n")

    @cached_property
    def stems(self) -> DataFrame:
        return self.sources.unionByName(self.targets)

    @cached_property
    def context_words(self) -> DataFrame:
        return D.members(self.vocab, self.dictionary).persist()

    @cached_property
    def context(self) -> DataFrame:
        return self.collected(self.stems).persist()

    def collected(self, stems: DataFrame, positions: bool = False) -> DataFrame:
        """Contexts of words (side, stem); texts are split into rows only where a join must find the context words."""
        texts = self.whole if 2 * self.p.dictionary <= sizes.FEW else self.sents
        return C.collect(texts, stems, self.context_words, self.p.window, self.p.window, positions)

    @cached_property
    def weighted(self) -> DataFrame:
        both = C.project(self.context, self.dictionary.select("src", "trg")).unionByName(self.context.where("side = 'trg'"))
        return C.weigh(both, self.totals)

    @cached_property
    def time(self) -> DataFrame:
        return T.align(T.collect_words(self.whole, self.stems), T.days_with_text(self.whole)).persist()

    @cached_property
    def time_prepared(self) -> DataFrame:
        return T.normalize(T.tumbling(self.time, self.p.window_days, ("side", "stem")), ("side", "stem"))

    def raw_scores(self, name: str = "s1") -> DataFrame:
        return C.score_by_name(self.context, self.dictionary.select("src", "trg"), self.totals, name)

    def context_scores(self, name: str = "s1") -> DataFrame:
        """Rounded, so that ties are ties whatever the order of summation."""
        return self.raw_scores(name).withColumn("score", F.round("score", 9))

    @cached_property
    def raw_time_scores(self) -> DataFrame:
        return T.cosine(self.time_prepared)

    @cached_property
    def time_scores(self) -> DataFrame:
        return self.raw_time_scores.withColumn("score", F.round("score", 9))

    def best_context(self, name: str = "s1") -> DataFrame:
        """Context scores of at least the ``keep`` best targets of each source; all of them where the sources are too many for every task."""
        weight, kind = C.SCORERS[name]
        both = C.project(self.context, self.dictionary.select("src", "trg")).unionByName(self.context.where("side = 'trg'"))
        vectors = C.weigh(both, self.totals, weight).select("side", "stem", F.col("ctx").alias("dim"), F.col("w").alias("v"))
        matrix = B.source_matrix(vectors)
        return self.context_scores(name) if matrix is None else B.best_products(vectors, matrix, self.p.keep, kind)

    @cached_property
    def best_time(self) -> DataFrame:
        """Time scores, as best_context."""
        matrix = B.source_matrix(self.time_vectors)
        return self.time_scores if matrix is None else B.best_products(self.time_vectors, matrix, self.p.keep).persist()

    @cached_property
    def time_vectors(self) -> DataFrame:
        return self.time_prepared.select("side", "stem", F.col("bin").alias("dim"), "v")

    def time_scores_of(self, pairs: DataFrame) -> DataFrame:
        """Time scores of some pairs (src, trg) that share a bin."""
        return P.pair_cosine(self.time_vectors, pairs).where("score <> 0").withColumn("score", F.round("score", 9))

    @cached_property
    def best_edit(self) -> DataFrame:
        """Edit distances, as best_context."""
        rows = B.few_sources(self.sources.select("stem"))
        if rows is None:
            return E.distance(E.pairs(self.sources, self.targets))
        return B.nearest_words([(r.stem, r.stem) for r in rows], self.targets.select("stem", F.col("stem").alias("word")), self.p.keep)

    # Phrases.

    @cached_property
    def phrase_rows(self) -> DataFrame:
        return V.phrase_rows(self.corpus)

    @cached_property
    def spans(self) -> DataFrame:
        return V.spans(self.phrase_rows, self.p.ngram)

    @cached_property
    def listed_spans(self) -> DataFrame:
        return V.listed_spans(self.phrase_rows, self.listed, self.p.ngram, "side", "day_idx")

    @cached_property
    def table(self) -> DataFrame:
        """(src, trg, fwd, bwd): the most frequent source phrases of dictionary words, translated word by word."""
        texts = self.phrase_texts if self.p.dictionary <= M.TRIE else self.phrase_rows
        counts = V.counts_of_known(texts.where("side = 'src'"), self.dictionary.select(F.col("src").alias("stem")), self.p.ngram)
        toks = counts.select("phrase", "n", "n_tok", F.posexplode(F.split("phrase", " ")).alias("i", "src"))
        known = toks.join(self.dictionary.select("src", "trg"), "src").groupBy("phrase", "n", "n_tok").agg(F.count("*").alias("k"), F.sort_array(F.collect_list(F.struct("i", "trg"))).alias("t"))
        whole = known.where("k = n_tok").select(F.col("phrase").alias("src"), F.array_join(F.transform("t", lambda x: x.trg), " ").alias("trg"), "n", "n_tok")
        top = whole.orderBy(F.desc("n"), "src").limit(self.p.phrases)
        each = F.transform(F.sequence(F.lit(0), F.col("n_tok") - 1), lambda i: F.array(i))
        return top.select("src", "trg", each.alias("fwd"), each.alias("bwd")).persist()

    @cached_property
    def listed(self) -> DataFrame:
        sides = [self.table.select(F.lit(s).alias("side"), F.col(s).alias("phrase")) for s in ("src", "trg")]
        return sides[0].unionByName(sides[1]).distinct()

    @property
    def held(self) -> bool:
        """Whether the listed phrases, two a row of the table, and the context words go to every task."""
        return 2 * self.p.phrases <= M.TRIE and 2 * self.p.dictionary <= sizes.FEW

    @cached_property
    def phrase_context(self) -> DataFrame:
        return P.collect_context(self.phrase_texts if self.held else self.phrase_rows, self.listed, self.context_words, self.p.ngram, self.p.window, self.p.window).persist()

    @cached_property
    def phrase_time(self) -> DataFrame:
        found = M.hit_counts(self.phrase_texts, M.trie_of(self.listed), self.p.ngram, "side", "day_idx") if self.held else self.listed_spans
        return T.collect_phrases(found).persist()

    @cached_property
    def phrase_time_vectors(self) -> DataFrame:
        ready = T.normalize(T.tumbling(self.phrase_time, self.p.window_days, ("side", "phrase")), ("side", "phrase"))
        return ready.select("side", F.col("phrase").alias("stem"), F.col("bin").alias("dim"), "v")

    def pair_scores(self, pairs: DataFrame) -> dict[str, DataFrame]:
        """Context and time scores of the given pairs."""
        ctx = P.pair_context_scores(self.phrase_context, self.dictionary.select("src", "trg"), self.totals, pairs)
        return {"context": ctx, "time": P.pair_cosine(self.phrase_time_vectors, pairs)}

    @cached_property
    def token_pairs(self) -> DataFrame:
        return P.links(self.table).select(F.col("a").alias("src"), F.col("b").alias("trg")).distinct()


def alignment_rows(table: DataFrame) -> DataFrame:
    return table.select("src", "trg", X.alignment(F.col("links")).alias("aligned"))
