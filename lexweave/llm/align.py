"""Alignment of two tokenizers' tokens by their bytes, and counts of linked ids over the corpus (operator 12)."""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .packing import byte_alphabet
from .pieces import gather, lists, map_texts, piece_bpe

#: Bytes of text that are aligned together; arrays of their tokens and links take some hundred times as much.
BYTES = 1 << 20
#: Parts that an id pair's rows are dealt to before they are added up.
SALT = 16
#: Pairs whose counts go to every task: the most frequent ones, about 2 MB. The others meet their documents in a join.
HEAD = 65_536


class ByteBpe:
    """Byte-level BPE of a file of the tokenizers library, special tokens being plain text; its merges must be in the order of ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], {x["content"] for x in spec["added_tokens"]}
        ids = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if spec["normalizer"] is not None or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or ids != sorted(set(ids)):
            raise ValueError("not a byte-level file with merges in the order of ids")
        of = byte_alphabet()
        ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in added}
        # The pattern of byte-level pre-tokenizers, a fixed value.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encode = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        surface = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            surface[i] = token
        self.offset = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        self.buffer = np.frombuffer(b"".join(surface), np.uint8)


@functools.lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def link(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two ways to cut the same bytes, given where their tokens end.

    Gives the group of each token on either side (groups end where tokens of both end) and, a pair of token places each, all
    links between tokens that share bytes.
    """
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    starts = np.concatenate([[0], ends_a[:-1]])
    first = np.searchsorted(ends_b, starts, side="right")
    times = np.searchsorted(ends_b, ends_a, side="left") - first + 1
    link_a = np.repeat(np.arange(len(ends_a)), times)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    return group_a, group_b, link_a, link_b


def write_groups(group_a: np.ndarray, group_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, size: int) -> np.ndarray:
    """Places in token_names(size) of both sides' tokens in the order of groups, A before B: each with the sign that stands before it."""
    group = np.concatenate([group_a, group_b])
    side = np.repeat([0, 1], [len(group_a), len(group_b)])
    order = np.argsort(2 * group + side, kind="stable")
    group, side = group[order], side[order]
    sign = np.where(np.diff(group, prepend=-1) > 0, 2, np.where(np.diff(side, prepend=1) != 0, 1, 0))
    return np.concatenate([ids_a, ids_b])[order] + sign * size


@functools.cache
def token_names(size: int) -> np.ndarray:
    """Ids below ``size`` after a comma, after a bar and after a semicolon."""
    return np.array([s + str(i) for s in (",", "|", ";") for i in range(size)], object)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<int>"


def align_texts(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Aligns each whole text's tokens by a byte-level file (A, of a space and the text) and a piece model (B): ALIGNED.

    ``groups`` spells the groups (`a1,a2|b1;a3|b2`), ``pairs`` holds each linked pair of ids once (A's id times 2^32 plus
    B's) and ``times`` how many links it has. A slice's texts are aligned together, through arrays: a text's end is a cut.
    Null and empty texts, and those that either side does not give back byte for byte, have no tokens: zeros, empty
    lists and an empty string. Texts of any length are aligned whole; null ids stay null; repeated rows give a row each
    and count as documents of their own; an empty table gives no rows; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> dict:
        a, b = byte_bpe(a_file), piece_bpe(b_file)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n = len(texts)
        parts = [np.array(a.encode(" " + t) if t else [], np.int64) for t in texts]
        ids_a = np.concatenate([*parts, np.empty(0, np.int64)])
        ends_a = np.cumsum([len(p) for p in parts])
        ids_b, ends_b = b.encode_all(pa.array(texts, pa.string()))
        ids_b = ids_b.astype(np.int64)
        same = []  # whether both sides' tokens give a space and the text
        bytes_a, bytes_b = gather(a.buffer, a.offset, ids_a), gather(b.buffer, b.offset, ids_b)
        at_a, at_b = (np.concatenate([[0], e])[np.concatenate([[0], ends])] for (_, e), ends in ((bytes_a, ends_a), (bytes_b, ends_b)))
        raw_a, raw_b = bytes_a[0].tobytes(), bytes_b[0].tobytes()
        for i, t in enumerate(texts):
            want = b" " + t.encode() if t else b""
            same.append(bool(t) and raw_a[at_a[i] : at_a[i + 1]] == want and raw_b[at_b[i] : at_b[i + 1]] == want)
        same = np.array(same, bool)
        doc_a, doc_b = np.repeat(np.arange(n), np.diff(ends_a, prepend=0)), np.repeat(np.arange(n), np.diff(ends_b, prepend=0))
        ids_a, doc_a = ids_a[same[doc_a]], doc_a[same[doc_a]]
        ids_b, doc_b = ids_b[same[doc_b]], doc_b[same[doc_b]]
        group_a, group_b, link_a, link_b = link(np.cumsum(np.diff(a.offset)[ids_a]), np.cumsum(np.diff(b.offset)[ids_b]))
        count = lambda docs: np.bincount(docs, minlength=n)
        n_groups = count(doc_a[np.flatnonzero(np.diff(group_a, prepend=-1))])
        size = max(len(a.offset), len(b.offset))
        spelt = token_names(size)[write_groups(group_a, group_b, ids_a, ids_b, size)].tolist()
        text_ends = np.cumsum(count(doc_a) + count(doc_b))
        starts = np.concatenate([[0], text_ends[:-1]])
        groups = ["".join(spelt[x:y])[1:] for x, y in zip(starts, text_ends, strict=True)]  # without the first sign
        width = len(b.offset)
        linked, times = np.unique((doc_a[link_a] * len(a.offset) + ids_a[link_a]) * width + ids_b[link_b], return_counts=True)
        doc, pair = np.divmod(linked, len(a.offset) * width)
        pair = (pair // width << 32) + pair % width
        ends = np.cumsum(count(doc))
        long = lambda x: pa.array(x, pa.int64())
        return {
            "doc_id": batch.column(0), "n_a": long(count(doc_a)), "n_b": long(count(doc_b)), "n_groups": long(n_groups), "n_links": long(count(doc_a[link_a])),
            "groups": pa.array(groups, pa.string()), "pairs": lists(pair, ends, pa.int64()), "times": lists(times, ends, pa.int32()),
        }

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, ALIGNED, BYTES, run)


def pair_counts(opened: DataFrame) -> DataFrame:
    """How many documents hold each pair linked (pair, docs), and whether no other pair of its A id has more (best).

    ``opened`` has a row for each document (row) and pair. Tasks add up what they hold, then SALT parts of each pair, then
    those parts. An A id has at most as many pairs as B has ids, and the best counts are at most as many as A has ids.
    """
    part = F.pmod(F.hash("row"), F.lit(SALT)).alias("part")
    counts = opened.groupBy("pair", part).agg(F.count("*").alias("docs")).groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def weigh_links(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Each document's alignment, summed up against the corpus: ALIGNED without its lists, with n_best and count_sum.

    n_best are the links whose pair is in as many documents as any pair of its A id, count_sum adds up their documents
    over all links. Texts are aligned once and written down. The ``head`` most frequent pairs' counts go to every task, so
    no pair of the join that finds the rest is in more documents than those; a document's sums are made where its pairs lie.
    """
    aligned = align_texts(df, a_file, b_file, id_col, text_col).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    aligned = settle(aligned.drop("groups").withColumn("row", F.monotonically_increasing_id()))
    opened = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = settle(pair_counts(opened))
    frequent = counts.orderBy(F.desc("docs"), "pair").limit(head).withColumnRenamed("docs", "head_docs").withColumnRenamed("best", "head_best")
    met = opened.join(F.broadcast(frequent), "pair", "left")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")]
    found = met.where(F.col("head_docs").isNotNull()).select("row", "times", F.col("head_docs").alias("docs"), F.col("head_best").alias("best")).groupBy("row").agg(*sums)
    rest = met.where(F.col("head_docs").isNull()).select("row", "pair", "times").join(counts, "pair").groupBy("row").agg(*sums)
    total = found.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = aligned.drop("pairs", "times").join(total, "row", "left").drop("row")
    return out.fillna(0, ["n_best", "count_sum"])
