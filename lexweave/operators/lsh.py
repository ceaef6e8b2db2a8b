"""Random-projection signatures of sparse vectors, the same on every run."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

BITS, POOL, WORD = 256, 100_000, 64
#: Features whose directions a task keeps, 2 KB each.
HELD = 20_000
MODULUS = 1 << 32


def seeds(n: int = BITS) -> list[int]:
    """The first n primes from 1009 on, a hash seed for each bit."""
    found, k = [], 1009
    while len(found) < n:
        if all(k % d for d in range(2, math.isqrt(k) + 1)):
            found.append(k)
        k += 2
    return found


def gaussian(index: Column) -> Column:
    """Entry of a pool of normal numbers, computed from its index."""
    i = index.cast("long")
    u = (F.pmod(i * 48271 + 11, F.lit(2147483647)) + 1) / 2147483648.0
    v = F.pmod(i * 69621 + 7, F.lit(2147483647)) / 2147483647.0
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def places(feature: Column) -> Column:
    """Pool index of the feature for every bit: a multiplicative string hash, folded into its part that the seed scales and
    the part that it does not, so that the characters are read once for all seeds."""
    chars = F.transform(F.filter(F.split(feature, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    start = F.struct(F.lit(1).cast("long").alias("p"), F.lit(0).cast("long").alias("h"))
    folded = F.aggregate(chars, start, lambda s, c: F.struct((s.p * 33 % MODULUS).alias("p"), ((s.h * 33 + c) % MODULUS).alias("h")))
    raw = F.transform(F.array(*(F.lit(s).cast("long") for s in seeds())), lambda s: (s * folded.p + folded.h) % MODULUS)
    return F.transform(raw, lambda x: F.when(x >= MODULUS // 2, MODULUS - x).otherwise(x) % POOL)


def _directions(features: list[str], held: dict[str, np.ndarray]) -> np.ndarray:
    """gaussian(places()) of each feature, a row a feature; held keeps those of before."""
    new = [f for f in features if f not in held]
    if len(held) + len(new) > HELD:
        held.clear()
        new = features
    if new:
        scale, rest = [], []
        for f in new:
            p, h = 1, 0
            for c in f:
                p, h = p * 33 % MODULUS, (h * 33 + ord(c)) % MODULUS
            scale.append(p)
            rest.append(h)
        raw = (np.array(scale, np.uint64)[:, None] * np.array(seeds(), np.uint64) + np.array(rest, np.uint64)[:, None]) % np.uint64(MODULUS)
        i = (np.where(raw >= MODULUS // 2, MODULUS - raw, raw) % POOL).astype(np.int64)
        u, v = ((i * 48271 + 11) % 2147483647 + 1) / 2147483648.0, ((i * 69621 + 7) % 2147483647) / 2147483647.0
        held.update(zip(new, np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * v), strict=True))
    return np.stack([held[f] for f in features])


def signatures(vectors: DataFrame, keys: tuple[str, ...] = ("side", "stem"), feature: str = "feature", value: str = "v") -> DataFrame:
    """(keys, sig): four 64-bit words, bit k set where the vector's projection on the k-th random direction is positive.

    Entries are dealt by key as they are and sorted there; each task adds up a batch's products with one matrix product a
    slice, so that no entry is opened into a row a bit, and holds one vector's sums at a time.
    """
    rows = vectors.select(*keys, F.col(feature).alias("feature"), F.col(value).cast("double").alias("v"))
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        last, total = None, np.zeros(BITS)

        def out(found: list[tuple], sums: np.ndarray) -> pa.RecordBatch:
            words = np.packbits(sums > 0, axis=1, bitorder="little").view("<i8")
            columns = [pa.array([x[i] for x in found], f.type) for i, f in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(words.tolist(), pa.list_(pa.int64()))], [*keys, "sig"])

        kinds: list[pa.Field] = []
        for batch in batches:
            kinds = [batch.schema.field(i) for i in range(k)]
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                own = list(zip(*(piece.column(i).to_pylist() for i in range(k)), strict=True))
                words = piece.column(k).dictionary_encode()
                products = _directions(words.dictionary.to_pylist(), held)[np.array(words.indices)] * np.array(piece.column(k + 1))[:, None]
                first = [i for i, x in enumerate(own) if i == 0 or x != own[i - 1]]
                sums, found = np.add.reduceat(products, first, axis=0), [own[i] for i in first]
                if last is not None:
                    if found[0] == last:
                        sums[0] += total
                    else:
                        sums, found = np.concatenate([total[None], sums]), [last, *found]
                last, total = found[-1], sums[-1]
                if len(found) > 1:
                    yield out(found[:-1], sums[:-1])
        if last is not None:
            yield out([last], total[None])

    schema = StructType([*(rows.schema[c] for c in keys), StructField("sig", ArrayType(LongType()))])
    return rows.where("feature is not null and v is not null").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def empty_signature() -> Column:
    return F.array(*(F.lit(0).cast("long") for _ in range(BITS // WORD)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """Estimated cosine, not below 0. Two empty vectors have equal signatures and score 1."""
    return F.greatest(F.lit(0.0), F.cos(math.pi * hamming(a, b) / BITS))


def packed(sig: Column) -> Column:
    """The signature as 32 bytes."""
    return F.unhex(F.array_join(F.transform(sig, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def pair_scores(table: DataFrame, sigs: DataFrame) -> DataFrame:
    """(src, trg, score) of the pairs of a table whose both sides have a signature; sigs: (side, stem, sig)."""
    src, trg = (sigs.where(F.col("side") == s).select(F.col("stem").alias(s), F.col("sig").alias(f"sig_{s}")) for s in ("src", "trg"))
    return table.select("src", "trg").join(src, "src").join(trg, "trg").select("src", "trg", similarity(F.col("sig_src"), F.col("sig_trg")).alias("score"))


def order_vectors(pctx: DataFrame, table: DataFrame) -> DataFrame:
    """(side, rel, stem, feature, v): neighbours as features, source ones through their translations."""
    trg = pctx.where("side = 'trg'").select("side", "rel", F.col("phrase").alias("stem"), F.col("ctx_phrase").alias("feature"), F.col("n").cast("double").alias("v"))
    src = pctx.where("side = 'src'").join(table.select(F.col("src").alias("ctx_phrase"), F.col("trg").alias("feature")).distinct(), "ctx_phrase")
    src = src.groupBy("side", "rel", F.col("phrase").alias("stem"), "feature").agg(F.sum("n").cast("double").alias("v"))
    return src.unionByName(trg)


def order_scores(pctx: DataFrame, table: DataFrame) -> DataFrame:
    """(src, trg, b_mono .. a_disc): similarities of the order signatures, not normalised; a missing vector is empty."""
    sigs = signatures(order_vectors(pctx, table), keys=("side", "rel", "stem")).persist()  # read five times
    out = table.select("src", "trg").distinct()
    for side, rels in (("src", ("before", "after")), ("trg", ("before", "after", "disc"))):
        for rel in rels:
            one = sigs.where((F.col("side") == side) & (F.col("rel") == rel)).select(F.col("stem").alias(side), F.col("sig").alias(f"{side}_{rel}"))
            out = out.join(one, side, "left").withColumn(f"{side}_{rel}", F.coalesce(f"{side}_{rel}", empty_signature()))
    cols = []
    for name, rel, mono, swap in (("b", "before", "before", "after"), ("a", "after", "after", "before")):
        cols += [similarity(F.col(f"src_{rel}"), F.col(f"trg_{k}")).alias(f"{name}_{what}") for what, k in (("mono", mono), ("swap", swap), ("disc", "disc"))]
    return out.select("src", "trg", *cols)
