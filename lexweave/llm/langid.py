"""Language identification by sparse multinomial logistic regression on character n-grams (operator 3)."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, discard, keep_rows, map_batches, map_slices, settle

#: Hashed n-gram buckets, and the n-gram lengths.
BITS, LENGTHS = 15, (1, 2, 3)
BUCKETS = 1 << BITS
#: Labelled rows of each language that the classifier is fitted on, at most.
PER_LANGUAGE = 400
UNDETERMINED = "und"


@functools.lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def buckets(text: str) -> np.ndarray:
    """Bucket of every n-gram of the lower-cased text with runs of non-letters as one blank; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    padded = np.full(len(points) + 2, 32, np.uint32)
    padded[1:-1] = np.where(letter, points, 32)
    blank = padded == 32
    padded = padded[~(blank & np.roll(blank, 1)) | (np.arange(len(padded)) == 0)]
    found, code = [], np.zeros(len(padded), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        code = code[: len(padded) - n + 1] * np.uint32(0x01000193) + padded[n - 1 :] + np.uint32(n)
        if n in LENGTHS:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
            found.append((mixed >> np.uint32(32 - BITS)).astype(np.int64))
    return np.concatenate(found)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    all_counts = np.bincount(buckets(text), minlength=BUCKETS)
    at = np.flatnonzero(all_counts)
    return at, all_counts[at]


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF."""
    value = (1 + np.log(n)) * idf[at]
    return value / max(np.sqrt((value**2).sum()), 1e-12)


class Ftrl:
    """Follow-the-regularised-leader with an elastic net, one weight a bucket and language."""

    def __init__(self, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax((value @ w)[None])[0]
        p[label] -= 1
        g = value[:, None] * p[None]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The factor on logits under which held-back labels are likeliest, found on a fine grid."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(-2, 3, 101))
    return float(grid[np.argmax([np.log(softmax(logits * t)[np.arange(len(labels)), labels] + 1e-12).sum() for t in grid])])


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    factor: float

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = counts(text or "")
        if not len(at) or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax((weigh(at, n, self.idf) @ self.weights[at])[None] * self.factor)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = 4) -> LanguageModel:
    """Learns from train (doc_id, text, lang; lang not null).

    Document frequencies count every row. The classifier is fitted on the ``per_language`` rows of each language that
    come first by a hash of id and text, rows that agree in both counting once; a fifth of them is held back for the
    temperature. One pass over the texts gives both. The share of the hashes that is looked at comes from the number of
    such rows of a language, so that the driver gets a bounded number of rows and no task a whole language.
    """
    order = F.xxhash64("doc_id", "text")
    sizes = train.select("lang", order.alias("h")).groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()  # a row a language
    # The share of the hashes that holds a quarter more than is asked for; the rest is cut off below.
    limits = {r.lang: round((min(1.0, 1.25 * per_language / r.n) - 0.5) * 2**64) for r in sizes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df_counts = np.zeros(BUCKETS, np.int64)
        rows = 0
        names = ["lang", "h", "at", "n"]
        types = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                piece, out = batch.slice(start, SLICE), []
                for lang, h, text in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                    at, n = counts(text or "")
                    df_counts[at] += 1
                    rows += 1
                    if h <= limits[lang] and len(at):
                        out.append((lang, h, at, n))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        at = np.flatnonzero(df_counts)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([rows], pa.int64()), pa.array([at], types[2]), pa.array([df_counts[at]], types[3])], names)

    passed = settle(map_batches(train.select("lang", order.alias("h"), "text"), run, "lang string, h long, at array<int>, n array<long>"))
    rows = passed.where("lang is null").agg(F.sum("h")).first()[0] or 0
    frequency = np.zeros(BUCKETS)
    totals = passed.where("lang is null").select(F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n"))
    for r in totals.collect():  # a row a bucket at most
        frequency[r.at] = r.n
    idf = np.log((1 + rows) / (1 + frequency)) + 1
    examples_of = passed.where("lang is not null").groupBy("lang", "h").agg(F.first("at").alias("at"), F.first("n").alias("n"))
    sample = sorted(examples_of.collect(), key=lambda r: (r.h, r.lang))  # a quarter more than per_language a language, about
    discard(passed)
    languages = sorted(limits)
    place = {x: i for i, x in enumerate(languages)}
    taken: dict[str, int] = dict.fromkeys(languages, 0)
    examples = []
    for r in sample:
        if taken[r.lang] < per_language:
            taken[r.lang] += 1
            at = np.array(r.at)
            examples.append((at, weigh(at, np.array(r.n), idf), place[r.lang]))
    held, learnt = examples[::5] if len(examples) >= 50 else [], [x for i, x in enumerate(examples) if i % 5 or len(examples) < 50]
    model = Ftrl(len(languages))
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(learnt)):
            model.learn(*learnt[i])
    weights = model.weights()
    logits = np.array([v @ weights[at] for at, v, _ in held]).reshape(len(held), len(languages))
    return LanguageModel(languages, idf, weights, temperature(logits, np.array([c for *_, c in held], int)))


def predict(df: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score (calibrated probability of lang_pred) of each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # buckets times languages

    def run(batch: pa.RecordBatch) -> dict:
        out = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "lang_pred": pa.array([x for x, _ in out], pa.string()), "score": pa.array([p for _, p in out], pa.float64())}

    return map_slices(df.select("doc_id", "text"), "doc_id long, lang_pred string, score double", run)


def identify(df: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Language of every whole text, learnt from the rows where ``learn`` holds and the language is known.

    A null text, one without a letter, and all texts when nothing can be learnt are ``und`` with score 0. Null ids are
    kept, repeated rows give a row each, an empty table gives no rows; other columns are ignored. Texts of any length are
    read whole; a worker holds a slice of 512 rows and the counts of one text. Of languages as likely as each other the
    first by name is given.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = rows.where(F.col("lang").isNotNull())
    return predict(rows, fit(known.where(learn) if learn is not None else known, per_language))


def keep_identified(df: DataFrame, least: float = 0.5, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows, with all columns, whose language is determined with a score of ``least`` or more, learnt from all known ones."""
    known = df.where(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    shared = df.sparkSession.sparkContext.broadcast(fit(known))

    def sure(text: str) -> bool:
        lang, p = shared.value.predict(text)
        return lang != UNDETERMINED and p >= least

    return keep_rows(df, text_col, sure)
