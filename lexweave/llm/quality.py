"""Quality scores from a regularised quadratic discriminant over document statistics (operator 9)."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_slices, settle, temporary

#: Shrinkage of each class covariance towards the pooled one, and of that towards its diagonal.
POOL, DIAGONAL, RIDGE = 0.4, 0.1, 1e-3

_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _PUNCT, _PLAIN = (np.zeros(256) for _ in range(7))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = _HIGH[128:] = 1
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_PUNCT[33:127] = 1
_PUNCT -= _PUNCT * (_UPPER + _LOWER + _DIGIT)
_PLAIN[[ord(c) for c in ".,;:'\"()-?"]] = 1
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _PUNCT, _PUNCT - _PUNCT * _PLAIN], 1)


def share(part: float, whole: float) -> float:
    """Logit of a share, kept finite by half a count on either side."""
    return float(np.log((part + 0.5) / (max(whole - part, 0.0) + 0.5)))


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text: logs of sizes, logits of shares."""
    data = text.encode("utf-8", "replace")
    upper, lower, digit, space, high, punct, odd = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES
    n, words, lines = len(data), text.split(), text.split("\n")
    k = len(words)
    letters = upper + lower + high
    triples = set(zip(words, words[1:], words[2:], strict=False))
    return [
        np.log1p(n),
        np.log1p(len(lines)) - np.log1p(k),
        np.log((n - space + 1) / (k + 1)),
        np.log(max(map(len, words), default=0) + 1),
        share(upper, letters),
        share(punct - odd, n),
        share(odd, n),
        share(digit, n),
        np.log((len(set(words)) + 1) / (k + 1)),
        np.log((len(triples) + 1) / (max(k - 2, 0) + 1)),
        np.log((len(set(lines)) + 1) / (len(lines) + 1)),
        np.log((len(zlib.compress(data, 1)) + 20) / (n + 20)),
        share(data.count(b".") + data.count(b"?"), k),
        share(data.count(b","), k),
    ]


SIZE = len(statistics(""))


@dataclass
class Discriminant:
    """Log-density difference of class 1 and class 0; holds one Cholesky factor a class, made once."""

    mean: np.ndarray
    scale: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray]] = field(default_factory=list)  # constant, centre, inverse factor
    prior: float = 0.5

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(rows), self.prior)
        z = (rows - self.mean) / self.scale
        logs = [c - 0.5 * (((z - m) @ inverse.T) ** 2).sum(1) for c, m, inverse in self.classes]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float, diagonal: float, ridge: float) -> Discriminant:
    """From count, sum and sum of outer products a class. With a class missing, every score is the other's share."""
    n = sum(m[0] for m in moments.values())
    if len(moments) < 2 or min(m[0] for m in moments.values()) < 2:
        ones = moments.get(1, (0,))[0]
        return Discriminant(np.zeros(SIZE), np.ones(SIZE), prior=float(ones / n) if n else 0.5)
    total, outer = sum(m[1] for m in moments.values()), sum(m[2] for m in moments.values())
    mean = total / n
    scale = np.sqrt(np.maximum(np.diag(outer) / n - mean**2, 1e-9))
    centres, spreads = {}, {}
    for c, (k, s, o) in moments.items():
        centres[c] = (s / k - mean) / scale
        spreads[c] = (o / k - np.outer(s / k, s / k)) / np.outer(scale, scale)
    pooled = sum(moments[c][0] / n * spreads[c] for c in moments)
    out = Discriminant(mean, scale, prior=float(moments[1][0] / n))
    for c in (0, 1):
        cov = (1 - pool) * spreads[c] + pool * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + ridge * np.eye(SIZE)
        factor = np.linalg.cholesky(cov)
        constant = np.log(moments[c][0] / n) - np.log(np.diag(factor)).sum()
        out.classes.append((float(constant), centres[c], np.linalg.inv(factor)))
    return out


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array x of a text's statistics; a null text counts as empty."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "x": pa.array([statistics(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))}

    return map_slices(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, x array<double>", run)


def fit(stats: DataFrame, labels: DataFrame, pool: float = POOL, diagonal: float = DIAGONAL, ridge: float = RIDGE) -> Discriminant:
    """Learns from all rows of labels (doc_id, label 0 or 1): Spark adds up the moments, a row a class comes back."""
    pairs = [(i, j) for i in range(SIZE) for j in range(i + 1)]
    known = labels.where("label in (0, 1)").join(stats, "doc_id")
    x = F.col("x")
    sums = known.groupBy("label").agg(F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(SIZE)), *(F.sum(x[i] * x[j]).alias(f"o{i}_{j}") for i, j in pairs))
    moments = {}
    for row in sums.collect():  # two rows at most
        outer = np.zeros((SIZE, SIZE))
        for i, j in pairs:
            outer[i, j] = outer[j, i] = row[f"o{i}_{j}"]
        moments[int(row.label)] = (float(row.n), np.array([row[f"s{i}"] for i in range(SIZE)]), outer)
    return discriminant(moments, pool, diagonal, ridge)


def score_quality(df: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """doc_id, score (0 to 1; higher: label 1 likelier) and predicted (score >= 0.5) of every whole text.

    ``labels`` has doc_id and label; ``learn`` (a condition on doc_id) says which of them may be learnt from. Texts are
    read once; their statistics are settled. Null and empty texts have the statistics of an empty text. Null labels and
    labels of absent rows count for nothing, repeated labels count each; with a class missing every score is the share of
    ones, or 0.5 without labels; a score of just 0.5 predicts 1. Texts of any length are read whole. Null ids are scored, repeated rows give a row each, an empty table gives no rows; other
    columns are ignored.
    """
    stats = settle(text_statistics(df, id_col, text_col))
    model = fit(stats, labels.where(learn) if learn is not None else labels, **settings)

    def run(batch: pa.RecordBatch) -> dict:
        x = np.array(batch.column(1).flatten()).reshape(-1, SIZE)
        score = model.scores(x)
        return {"doc_id": batch.column(0), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    return map_slices(stats, "doc_id long, score double, predicted int", run)


def keep_good(df: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """The rows, with all columns, whose score is ``least`` or more; scores as in score_quality, learnt from all labels."""
    with temporary():
        model = fit(settle(text_statistics(df, id_col, text_col)), labels, **settings)
    return keep_rows(df, text_col, lambda text: model.scores(np.array([statistics(text)]))[0] >= least)
