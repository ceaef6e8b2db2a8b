"""Near-duplicate documents by one-permutation MinHash (operator 8)."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_slices, settle, temporary
from .components import components

#: At 0.8 a band of six agrees with probability 0.26; all forty miss in one pair of two hundred thousand.
BANDS, ROWS = 40, 6
#: Buckets of so many sets or fewer give all their pairs; larger ones give stars, in each round around so many centres.
ALL_PAIRS, STARS = 8, (1, 8)
#: Members that meet one copy of a centre's set.
SALT = 500
#: Members of a block, about, on either side, and bits of the sketches that blocks are screened by.
BLOCK, BITS = 4096, 2048

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of fewer words, the whole sequence as one."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    runs = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        runs = mix(runs * _STEP + hashes[k : k + len(runs)])
    return np.unique(runs)


@functools.lru_cache(4)
def probes(bins: int) -> np.ndarray:
    """For every bin an order in which other bins are asked for a value, the same everywhere."""
    rng = np.random.default_rng(bins)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One permutation: the least hash of each bin; an empty bin takes that of the first filled bin in its own probe order."""
    bins = bands * rows
    place = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    filled, first = np.unique(place.astype(np.int64), return_index=True)
    values, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[filled], full[filled] = hashes[first], True
    if len(filled) < bins:
        empty = np.flatnonzero(~full)
        order = probes(bins)[empty]
        values[empty] = values[order[np.arange(len(empty)), full[order].argmax(1)]]
    keys = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for column in values.reshape(bands, rows).T:
        keys = mix(keys + column)
    return keys.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """id, n (set size), set_key (128-bit hash of the set, null if empty), bands of each row of docs (id, text)."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
        return {
            "id": batch.column(0),
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "set_key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            "bands": pa.array([band_keys(s, bands, rows) if len(s) else None for s in sets], pa.list_(pa.int64())),
        }

    return map_slices(docs, "id long, n long, set_key binary, bands array<long>", run)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """id (the node) and hashes of the rows of docs (node, set_key, text) whose text has the set of set_key."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, width) for t in batch.column(2).to_pylist()]
        own = [i for i, (s, key) in enumerate(zip(sets, batch.column(1).to_pylist(), strict=True)) if xxhash.xxh3_128_digest(s.tobytes()) == key]
        return {"id": batch.column(0).take(pa.array(own, pa.int64())), "hashes": pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))}

    return map_slices(docs.select("node", "set_key", "text"), "id long, hashes array<long>", run)


def bucket_hubs(members: DataFrame, stars: int, seed: int) -> DataFrame:
    """(band, size, c): of every bucket of two or more its size and its centres, nothing else is gathered.

    A single centre comes first by a hash of the id, so that a group's buckets share few of them; several come first by
    hashes of id and bucket, so that buckets differ.
    """
    by = ["id"] if stars == 1 else ["id", "band"]
    first = [F.min(F.struct(F.xxhash64(*by, F.lit(seed + k)).alias("h"), "id", "n")).alias(f"c{k}") for k in range(stars)]
    buckets = members.groupBy("band").agg(F.count("*").alias("size"), *first).where("size > 1")
    return buckets.select("band", "size", F.array_distinct(F.array(*(F.struct(F.col(f"c{k}.id").alias("id"), F.col(f"c{k}.n").alias("n")) for k in range(stars)))).alias("c"))


EDGE = ["id", "n", "centre", "centre_n"]


def star_edges(some: DataFrame, hubs: DataFrame) -> DataFrame:
    """Edges from some members (band, id, n) to the centres of their large buckets."""
    joined = some.join(hubs.where(F.col("size") > ALL_PAIRS), "band")
    return joined.select("id", "n", F.explode("c").alias("c")).select("id", "n", F.col("c.id").alias("centre"), F.col("c.n").alias("centre_n")).where("id <> centre")


def small_pairs(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """All pairs of small buckets, at most ALL_PAIRS members each."""
    few = members.join(hubs.where(F.col("size") <= ALL_PAIRS).select("band"), "band").groupBy("band").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("m"))
    ordered = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y.id > x.id), lambda y: F.struct(y.id.alias("id"), y.n.alias("n"), x.id.alias("centre"), x.n.alias("centre_n")))))
    return few.select(F.explode(ordered).alias("p")).select("p.*")


def sketches(sets: DataFrame) -> DataFrame:
    """id, sketch of each full set: the parity of the hashes that fall on each of BITS bits."""

    def parity(hashes) -> bytes:
        place = np.asarray(hashes, np.int64) & (BITS - 1)
        return np.packbits(np.bincount(place, minlength=BITS) & 1).tobytes()

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "sketch": pa.array([parity(h) for h in batch.column(1).to_pylist()], pa.binary())}

    return map_slices(sets.select("id", "hashes"), "id long, sketch binary", run)


def screen(ask: dict, base: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (asking, base) of different classes whose sketches allow the likeness.

    Sketches differ in no more bits than sets in members, so that no pair as alike as asked is left out. Two members that
    both ask meet twice and count once.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(ask["id"])):
        js = np.flatnonzero((base["class"] != ask["class"][i]) & (~base["asks"] | (base["id"] > ask["id"][i])))
        apart = np.bitwise_count(base["sketch"][js] ^ ask["sketch"][i]).sum(1, dtype=np.int64)
        js = js[apart * (100 + percent) <= (ask["n"][i] + base["n"][js]) * (100 - percent)]
        left.append(np.full(len(js), i))
        right.append(js)
    return np.concatenate(left), np.concatenate(right)


def open_groups(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(joint, key, id, n, class, asks) of the large buckets that stars left with several classes (node, component).

    A member outside its bucket's most frequent class asks all members of the bucket; pairs within that class need no
    answer. Buckets of one most frequent class, such as the forty of a large group of near copies, become one group,
    where that takes fewer comparisons than each bucket for itself (the union of buckets holds all their pairs).
    """
    named = members.join(classes, F.col("id") == F.col("node"), "left").select("band", "id", "n", F.coalesce("component", "id").alias("class"))
    tally = named.groupBy("band", "class").agg(F.count("*").alias("c"))
    top = tally.groupBy("band").agg(F.sum("c").alias("size"), F.count("*").alias("classes"), F.max(F.struct("c", "class")).alias("top"))
    several = top.where(f"size > {ALL_PAIRS} and classes > 1").select("band", F.col("top.class").alias("main"))
    rest = settle(named.join(several, "band").withColumn("asks", F.col("class") != F.col("main")))
    each = rest.groupBy("main", "band").agg((F.count("*") * F.count_if("asks")).cast("double").alias("pairs")).groupBy("main").agg(F.sum("pairs").alias("apart"))
    members_of = rest.groupBy("main", "id").agg(F.bool_or("asks").alias("asks"))
    once = members_of.groupBy("main").agg((F.count("*").cast("double") * F.count_if("asks")).alias("joined"))
    joint = rest.select("main", "band").distinct().join(each.join(once, "main").where("joined <= apart").select("main"), "main").select("band")
    together = rest.join(joint, "band", "left_semi").select(F.lit(True).alias("joint"), F.col("main").alias("key"), "id", "n", "class", "asks").distinct()
    alone = rest.join(joint, "band", "left_anti").select(F.lit(False).alias("joint"), F.col("band").alias("key"), "id", "n", "class", "asks")
    return settle(together.unionByName(alone))


def rest_pairs(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """EDGE pairs of large buckets that stars left in different classes: the rest, without a cap.

    A group of open_groups() is cut by size of the set, so that only neighbouring steps can hold alike sets, and each step
    into blocks of BLOCK members by a hash. A member lies in one block of its step; one that asks goes to the blocks of
    three steps, and beyond BLOCK such members they are cut into lots too, so that a task holds two blocks at most.
    Sketches screen there, so rows and not pairs are shuffled: about three a member, and three a block and asking member.
    """
    step = F.floor(F.log("n") / math.log(101 / percent)).cast("int")
    placed = open_groups(members, classes).withColumn("step", step)
    drawn = settle(sketches(sets.join(placed.select("id").distinct(), "id", "left_semi")))
    cut = placed.groupBy("joint", "key", "step").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.ceil(F.count_if("asks") / BLOCK).cast("int").alias("lots"))
    plan = cut.groupBy("joint", "key").agg(F.map_from_entries(F.collect_list(F.struct("step", F.struct("parts", "lots")))).alias("plan"))  # a few dozen steps
    dealt = placed.join(plan, ["joint", "key"]).join(drawn, "id")
    dealt = dealt.withColumn("part", F.expr("int(pmod(xxhash64(id), plan[step].parts))")).withColumn("lot", F.expr("int(pmod(xxhash64(id, 1), greatest(plan[step].lots, 1)))"))
    near = "filter(array(step - 1, step, step + 1), x -> coalesce(try_element_at(plan, x).{}, 0) > 0)"
    base = F.expr(f"flatten(transform({near.format('lots')}, s -> transform(sequence(0, plan[s].lots - 1), l -> struct(s AS s, step AS t, part AS p, l AS l, false AS asking))))")
    ask = F.expr(f"flatten(transform({near.format('parts')}, t -> transform(sequence(0, plan[t].parts - 1), p -> struct(step AS s, t AS t, p AS p, lot AS l, true AS asking))))")
    met = dealt.select("joint", "key", "id", "n", "class", "asks", "sketch", F.explode(F.when(F.col("asks"), F.concat(base, ask)).otherwise(base)).alias("b"))

    def run(group: pa.Table) -> pa.Table:
        asking = group.column("asking").to_numpy()
        m = {k: group.column(k).to_numpy() for k in ("id", "n", "class", "asks")}
        m["sketch"] = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(len(group), -1)
        a, b = ({k: x[side] for k, x in m.items()} for side in (asking, ~asking))
        i, j = screen(a, b, percent)
        return pa.table(dict(zip(EDGE, (a["id"][i], a["n"][i], b["id"][j], b["n"][j]))))

    rows = met.select("joint", "key", "b.s", "b.t", "b.p", "b.l", "id", "n", "class", "asks", "sketch", "b.asking")
    return rows.groupBy("joint", "key", "s", "t", "p", "l").applyInArrow(run, "id long, n long, centre long, centre_n long")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (id, centre) whose full sets are as alike as asked. A centre of many is copied once for every SALT of them.

    All joins go by shuffle, few pairs or many, so that the plan is the same at every size.
    """
    load = pairs.groupBy("centre").agg(F.ceil(F.count("*") / SALT).cast("int").alias("copies"))
    salted = pairs.join(load, "centre").withColumn("salt", F.expr("pmod(xxhash64(id), copies)").cast("int"))
    mine = salted.hint("merge").join(sets, "id").select("id", "centre", "salt", "hashes")
    theirs = load.hint("merge").join(sets.withColumnRenamed("id", "centre"), "centre").select("centre", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.col("hashes").alias("others"))
    both = F.size(F.array_intersect("hashes", "others"))
    met = mine.hint("merge").join(theirs, ["centre", "salt"]).withColumn("both", both).withColumn("all", F.size("hashes") + F.size("others") - F.col("both"))
    return met.where(F.col("both") * 100 >= F.col("all") * percent).select("id", "centre")


def links(docs: DataFrame, firsts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) of nodes, or such as give the same classes, among the sets in firsts (node, id, set_key, n, bands).

    Buckets are sized first and those of one member dropped; the texts of the others' members are read once for their
    full sets. Small buckets give all pairs, large ones a star. Sets that are then linked with nothing are compared with
    more centres of all their large buckets. What stars leave in different classes of a large bucket is compared in
    blocks, whatever its size. Links that stars found are given as links to the least of their class. Texts are dealt by
    id whatever the size, so that the plan is the same everywhere.
    """
    every = firsts.select(F.col("node").alias("id"), "n", F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
    members = settle(every.join(shared, "band", "left_semi"))
    needed = firsts.select("id", "node", "set_key").join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    sets = settle(shingle_sets(docs.join(needed.hint("merge"), "id"), width).dropDuplicates(["id"]))
    found, some = None, members
    fits = F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * percent
    for turn, stars in enumerate(STARS):
        hubs = settle(bucket_hubs(members, stars, 100 * turn))
        edges = star_edges(some, hubs)
        if not turn:
            edges = edges.select(EDGE).unionByName(small_pairs(members, hubs))
        asked = settle(edges.where(fits).select(F.greatest("id", "centre").alias("id"), F.least("id", "centre").alias("centre")).distinct())
        confirmed = settle(confirm(asked, sets, percent))
        found = confirmed if found is None else found.unionByName(confirmed)
        linked = found.select("id").unionByName(found.select(F.col("centre").alias("id"))).distinct()
        some = members.join(linked, "id", "left_anti")
        discard(asked, hubs)
    linked = settle(components(found.select(F.col("id").alias("a"), F.col("centre").alias("b"))))
    rest = rest_pairs(members, linked, sets, percent).where(fits)
    asked = settle(rest.select(F.greatest("id", "centre").alias("id"), F.least("id", "centre").alias("centre")).distinct())
    more = settle(confirm(asked, sets, percent))
    discard(asked, sets, members)
    return linked.toDF("a", "b").unionByName(more.toDF("a", "b"))


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row: documents linked where the sets of word runs are alike by ``percent``.

    Equal sets are one class, a node of its own even where rows of one id lead several, so copies cost no pairs. Candidates
    come from banded buckets as stars around a centre and are confirmed on the full sets. Words are runs of other than
    ASCII white space with A-Z lowered. Null or empty texts have size 0 and are linked with nothing. Texts of any length
    are hashed whole; a worker holds a slice of 512 rows. Rows of one id are one document, with the links of any of them;
    a null id is linked with nothing, its component is null and it is kept. An empty table gives no rows; other columns are
    ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = settle(signatures(docs, width, bands, rows))
    usable = signed.where("n > 0 and id is not null")
    firsts = usable.groupBy("set_key").agg(F.min(F.struct("id", "n", "bands")).alias("f")).select("set_key", "f.*")
    classes = settle(firsts.withColumn("node", F.monotonically_increasing_id()))  # written once, so that numbers stay
    joined = links(docs, classes, width, percent)
    # Rows of one id with several texts tie their classes together.
    repeated = usable.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("id").alias("own"))
    several = usable.join(repeated, usable.id == repeated.own, "left_semi").join(classes.select("set_key", "node"), "set_key").select("id", "node").distinct()
    ties = several.join(several.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b")
    reached = settle(components(joined.unionByName(ties)))
    numbers = classes.select("node", "set_key", F.col("id").alias("first"))
    least = reached.join(numbers, "node").groupBy("component").agg(F.min("first").alias("least"))
    grouped = numbers.join(reached, "node", "left").join(least, "component", "left")
    named = settle(grouped.select("set_key", F.coalesce("least", "first").alias("component")))
    out = signed.select("id", "n", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """The rows, with all columns, of one document of each near-duplicate group, that of the smallest id.

    Of rows of one id one is kept; rows without id are kept.
    """
    with temporary() as kept:
        near = near_duplicates(df, id_col=id_col, text_col=text_col, **settings)
        stay = settle(near.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")))
        kept.append(stay)
    one = df.join(stay.where("n = 1").select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
    if not stay.where("n > 1").isEmpty():
        more = df.join(stay.where("n > 1").select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
        one = one.unionByName(more.dropDuplicates([id_col]))
    return one.unionByName(df.where(F.col(id_col).isNull()))
