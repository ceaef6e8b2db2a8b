"""Column functions on text: splitting, word forms, n-grams, alignments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The delimiter classes of words and sentences, and what makes a word unusable.
WORD_DELIMITERS = r"[|$*\s\"'\-+=,;:«»{}()<>\[\].?¿!¡–“”‘’ ]+"
SENTENCE_DELIMITERS = r"[|.?¿!¡]+"
PHRASE_SENTENCE_END = r".?¿!¡"
GARBAGE = r"[`;\[\]|,.\"'{}?)(=\-><*:#%&/\\]"
DIGITS = r"[0-9]"
ROMAN = r"[a-zA-Z]"
DICTIONARY_NOISE = r"[,0-9_*.]"


def word_form(word: Column, case_sensitive: bool = False) -> Column:
    """Trimmed, and lower-cased unless case matters."""
    return F.trim(word) if case_sensitive else F.lower(F.trim(word))


def words(text: Column) -> Column:
    """Words between delimiters. A leading empty word stays and takes a place; trailing empty words go.

    An empty part is the first or the last one, so that the text is split once and each part is looked at once.
    """
    return F.filter(F.split(text, WORD_DELIMITERS), lambda w, i: (w != "") | ((i == 0) & has_words(text)))


def has_words(text: Column) -> Column:
    """Whether words() finds any; it ends at the first letter that belongs to one."""
    return text.rlike("[^" + WORD_DELIMITERS[1:-1])


def sentences(line: Column, one_a_line: bool = False) -> Column:
    """Likely sentences; their delimiters are lost. Trailing empty ones go."""
    if one_a_line:
        return F.array(line)
    return F.filter(F.split(line, SENTENCE_DELIMITERS), lambda x, i: (x != "") | ((i == 0) & (line != "")))


def phrase_sentences(line: Column, one_a_line: bool = False) -> Column:
    """Sentences of the trimmed line with their delimiters at the end; what is left over is a sentence as well."""
    line = F.trim(line)
    if one_a_line:
        return F.array(line)
    end = PHRASE_SENTENCE_END
    return F.regexp_extract_all(line, F.lit(f"[^{end}]*[{end}]+|[^{end}]+$"), F.lit(0))


def tokens(sentence: Column) -> Column:
    """White-space tokens; punctuation stays attached."""
    return F.filter(F.split(sentence, r"\s+"), lambda t: t != "")


def has_tokens(sentence: Column) -> Column:
    return sentence.rlike(r"\S")


def ngrams(toks: Column, longest: int) -> Column:
    """All spans of up to ``longest`` tokens (less than 0: of any length), by start, then length: struct(pos, n, text)."""
    size = F.size(toks)

    def at(start: Column) -> Column:
        most = size - start if longest < 0 else F.least(F.lit(longest), size - start)
        return F.transform(F.sequence(F.lit(1), most), lambda n: F.struct(start.alias("pos"), n.alias("n"), F.array_join(F.slice(toks, start + 1, n), " ").alias("text")))

    return F.when(size > 0, F.flatten(F.transform(F.sequence(F.lit(0), size - 1), at)))


def token_count(phrase: Column) -> Column:
    return F.size(F.split(phrase, r"\s+"))


def alignment(text: Column) -> Column:
    """``(0) (1,2) ()`` as array<array<int>>; ``()`` is null."""
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: F.when(x != "()", F.split(F.regexp_replace(x, r"[()]", ""), ",").cast("array<int>")))


def window_words(toks: Column, left: int, right: int) -> Column:
    """For every token a struct of the token and the tokens around it."""
    return F.transform(
        toks,
        lambda x, i: F.struct(
            x.alias("stem"),
            F.concat(F.slice(toks, F.greatest(i - left, F.lit(0)) + 1, F.least(i, F.lit(left))), F.slice(toks, i + 2, F.lit(right))).alias("around"),
        ),
    )


def window_words_at(toks: Column, left: int, right: int) -> Column:
    """As window_words, each neighbour tagged ``|s:`` and its distance."""

    def near(i: Column) -> Column:
        span = F.sequence(F.greatest(i - left, F.lit(0)), F.least(i + right, F.size(toks) - 1))
        return F.transform(F.filter(span, lambda k: k != i), lambda k: F.concat(F.element_at(toks, k + 1), F.lit("|s:"), (k - i).cast("string")))

    return F.transform(toks, lambda x, i: F.struct(x.alias("stem"), near(i).alias("around")))


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two strings; of a sorted group's first and last it is that of the group."""
    n = F.least(F.length(a), F.length(b))
    span = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.substring(a, F.lit(1), F.size(F.filter(span, lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))))
