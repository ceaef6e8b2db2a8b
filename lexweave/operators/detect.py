"""Language of pages that don't say it: a detector that can be exchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import profiles as P

# Frequent short words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as be by on are this from or an",
    "fr": "le la les de des et un une est que qui dans pour par sur au du en il elle",
    "de": "der die das und ist nicht ein eine zu den von mit sich auf für dem des als auch im",
    "es": "el la los las de y que en un una es por con para del se su como más lo",
}


def function_word_detector(text: Column, least: int = 3, lead: float = 1.2) -> Column:
    """struct(lang, reliable): the language with most of its frequent words in the text; reliable if there are ``least`` of
    them and ``lead`` times as many as of the next."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def hits(known: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*known)))

    found = F.array(*(F.struct(hits(known.split()).alias("n"), F.lit(code).alias("lang")) for code, known in FUNCTION_WORDS.items()))
    ranked = F.sort_array(found, asc=False)
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.struct(first.lang.alias("lang"), ((first.n >= least) & (first.n >= lead * second.n)).alias("reliable"))


def by_function_words(samples: DataFrame) -> DataFrame:
    """(url, lang) of the samples (url, text) whose language their frequent words tell reliably."""
    return samples.select("url", function_word_detector(F.col("text")).alias("d")).where("d.reliable").select("url", "d.lang")


def by_profiles(learnt: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A detector by n-gram profiles, learnt from (lang, text)."""
    profiles = P.learn(learnt)
    return lambda samples: P.tell(samples, profiles).where("reliable").select("url", "lang")


def fill_language(versions: DataFrame, detector: Callable[[DataFrame], DataFrame] = by_function_words) -> DataFrame:
    """Pages without language get that of their first version with content, if the detector, from (url, text) to (url, lang),
    gives one. Pages that know theirs are not looked at."""
    first = versions.where("content <> '' and lang is null").groupBy("url").agg(F.min_by("content", F.struct("fetched", "segment_id")).alias("text"))
    told = detector(first).withColumnRenamed("lang", "detected")
    return versions.join(told, "url", "left").withColumn("lang", F.coalesce("lang", "detected")).drop("detected")
