"""Cheapest repair of conversations' turn structure (operator 11)."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: White space as the contract names it.
SPACE = " \t\n\x0b\f\r"
#: Where a letter leads from each state: nothing yet, after a system turn, after a user's, after an assistant's.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
STATES, ENDS = range(4), (0, 3)
FAR = 1 << 40

INSERTS = [("I", x, y, INSERT) for role in ROLES for x, y in STEP[role].items()]


def arcs(initial: str, fault: str | None) -> list[tuple[str, int, int, int]]:
    """What may be done with a row: edit, state before, state after, cost."""
    out = [("D", s, s, DELETE) for s in STATES]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        out += [("K", x, y, KEEP + more) for x, y in STEP.get(initial, {}).items()]
        out += [("R", x, y, REROLE + more) for role in ROLES for x, y in STEP[role].items()]
    return out


FAULTS = (None, "blank", "duplicate", "truncated")
INITIALS = ("s", "u", "a", "")
#: Arcs by a row's code: FAULTS times INITIALS.
ARCS = [arcs(i, f) for f in FAULTS for i in INITIALS]


def code_of(initial: str, fault: str | None) -> int:
    return FAULTS.index(fault) * len(INITIALS) + (INITIALS.index(initial) if initial in STEP else 3)


def relax(costs: list[int], pairs: list[tuple[int, int]]) -> list[int]:
    """Inserted turns: a pass in each of the two orders is enough, as a chain that repeats a state never pays."""
    for _ in range(2):
        for x, y in pairs:
            costs[y] = min(costs[y], costs[x] + INSERT)
    return costs


INSERT_STEPS = [(x, y) for _, x, y, _ in INSERTS]
INSERT_BACK = [(y, x) for x, y in INSERT_STEPS]


def cheapest(codes: bytes | bytearray) -> tuple[int, str]:
    """The least cost to give `(s?(ua)+)?`, and of all cheapest ways the ASCII-least string of edits.

    Least costs from the start and to the end of every place and state tell which edits lie on a cheapest way. All ways
    with the same edits so far stand at the same row, so the walk holds a set of states there and takes the least edit
    that leads on from any of them. Holds some 64 bytes a row.
    """
    n = len(codes)
    ahead, back = array("q", [FAR]) * (4 * (n + 1)), array("q", [FAR]) * (4 * (n + 1))
    now = relax([0, FAR, FAR, FAR], INSERT_STEPS)
    ahead[0:4] = array("q", now)
    for i, code in enumerate(codes):
        then = [FAR] * 4
        for _, x, y, w in ARCS[code]:
            if now[x] + w < then[y]:
                then[y] = now[x] + w
        now = relax(then, INSERT_STEPS)
        ahead[4 * i + 4 : 4 * i + 8] = array("q", now)
    now = relax([0 if s in ENDS else FAR for s in STATES], INSERT_BACK)
    back[4 * n : 4 * n + 4] = array("q", now)
    for i in range(n - 1, -1, -1):
        then = [FAR] * 4
        for _, x, y, w in ARCS[codes[i]]:
            if now[y] + w < then[x]:
                then[x] = now[y] + w
        now = relax(then, INSERT_BACK)
        back[4 * i : 4 * i + 4] = array("q", now)
    total, at, frontier, out = back[0], 0, {0}, []
    while not (at == n and any(s in ENDS and ahead[4 * n + s] == total for s in frontier)):
        best, reached = "Z", set()
        for step, choices in ((0, INSERTS), (1, ARCS[codes[at]] if at < n else [])):
            for edit, x, y, w in choices:
                if edit <= best and x in frontier and ahead[4 * at + x] + w + back[4 * (at + step) + y] == total:
                    if edit < best:
                        best, reached, ahead_by = edit, set(), step
                    reached.add(y)
        out.append(best)
        at, frontier = at + ahead_by, reached
    return total, "".join(out)


def mark_faults(rows: DataFrame) -> DataFrame:
    """Without the text: each row's ``mark``, a hash of its text, the number of its copies so far, and its first fault (blank, duplicate, truncated or null)."""
    text = F.rtrim(F.col("text"), F.lit(SPACE))
    small = rows.select("conv_id", "turn", "role", text_mark().alias("mark"), (text == "").alias("blank"), F.right(text, F.lit(1)).isin(".", "!", "?").alias("ended"))
    copy = F.row_number().over(Window.partitionBy("conv_id", "role", "mark").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(F.col("blank"), "blank").when(F.col("copy") > 1, "duplicate").when(~F.col("ended"), "truncated")
    return small.withColumn("copy", copy).select("conv_id", "turn", "role", "mark", "copy", fault.alias("fault"))


def text_mark() -> Column:
    return F.md5(F.col("text").cast("binary"))


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, place long, edit string, role string, text string"
LEGAL = ("su", "ua", "au")


class Conversation:
    """What is held of a conversation while its rows pass by: a byte a row, then its edits."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.audit, self.cost = conv_id, bytearray(), None, 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.turns = self.illegal = 0
        self.low = self.high = self.initial = None

    def see(self, turn: int | None, role: str, fault: str | None) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        self.faults[fault] += 1
        self.codes.append(code_of(initial, fault))

    def plan(self) -> None:
        self.cost, self.audit = cheapest(self.codes)
        self.at = self.made = self.row = 0
        self.odd = (len(self.audit) - self.audit.count("D")) % 2  # then a system turn comes first

    def next_role(self) -> str:
        return "user" if self.made % 2 == self.odd else "assistant"

    def inserted(self) -> Iterator[tuple[str, str | None, str | None]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self.edit("I", None, "")

    def edit(self, letter: str, role: str | None, text: str | None) -> tuple[str, str | None, str | None]:
        self.at += 1
        if letter == "D":
            return letter, None, None
        role = role if letter == "K" else self.next_role()
        self.made += 1
        return letter, role, text

    def apply(self, role: str, text: str) -> Iterator[tuple[str, str | None, str | None]]:
        """Edits up to and including that of the next row: letter, role and text (both null where the row goes)."""
        yield from self.inserted()
        yield self.edit(self.audit[self.at], role, text)

    def summary(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, self.cost, self.audit)


def stream(rows: DataFrame, extra: DataFrame | None, summed: bool) -> DataFrame:
    """Brings each conversation's rows together in order, first without texts, to plan its edits, then with them."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    plans = mark_faults(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "mark", "copy", "fault", F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv_id", F.lit(2).alias("kind"), "turn", "role", text_mark().alias("mark"), F.lit(0).alias("copy"), F.lit(None).cast("string").alias("fault"), "text")
    every = plans.unionByName(texts)
    if extra is not None:
        every = every.unionByName(extra.select("conv_id", F.lit(0).alias("kind")), allowMissingColumns=True)
    dealt = every.select(F.col("conv_id").cast("long").alias("conv_id"), "kind", "turn", "role", "mark", "copy", "fault", "text").repartition("conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", "kind", "turn", "role", "mark", "copy").drop("mark", "copy")
    schema = SUMMARY if summed else EDITS
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Conversation | None = None
        out: list[tuple] = []
        digest = None

        def take(edits: Iterator[tuple[str, str | None, str | None]]) -> None:
            for letter, role, text in edits:
                if not summed:
                    out.append((current.conv_id, current.at - 1, letter, role, text))
                elif letter != "D":
                    digest.update((("\n" if current.made > 1 else "") + f"{role}:{text}").encode("utf-8", "replace"))

        def close() -> None:
            if current.audit is None:
                current.plan()
            take(current.inserted())
            if summed:
                out.append((*current.summary(), digest.hexdigest()))

        for batch in batches:
            for conv_id, kind, turn, role, fault, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        close()
                    current, digest = Conversation(conv_id), hashlib.sha256()
                if kind == 1:
                    current.see(turn, role, fault)
                elif kind == 2:
                    if current.audit is None:
                        current.plan()
                    take(current.apply(role, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out.clear()
        if current is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return map_batches(dealt, run, schema)


def repair_rows(rows: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation, in order: EDITS, a row an edit, with the turn that it leaves.

    ``rows`` has conv_id, turn, role, text. Keep (K) costs 0, Rerole to user or assistant (R) 1, Delete (D) 2, Insert (I) of
    an empty turn 5; a truncated row that stays adds 5; blank rows and duplicates must go. The roles that are left spell
    `(s?(ua)+)?`; of equally cheap ways the ASCII-least string of letters is taken. Deleted rows have null role and text.

    Rows go by turn, null turns first, rows of one turn by role and a hash of their text; null roles and texts are one space.
    A null conv_id is a conversation of its own; a repeated row is a duplicate; texts of any length stream through and only
    some 70 bytes a row are held of a conversation, besides its string of edits. Other columns are ignored; an empty table
    gives no rows. A conversation passes through one task, as its string of edits and its hash need all of it in order.
    """
    return stream(rows, None, summed=False)


def repair_summary(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """A row a conversation: SUMMARY, faults before the repair (as for repair_rows), its cost, edits and hash afterwards.

    ``conversations`` (conv_id) adds conversations that may have no rows: zeros, no edits, the hash of an empty string.
    """
    return stream(rows, conversations, summed=True)


def damage(rows: DataFrame) -> DataFrame:
    """Breaks rows by crc32(`conv_id:turn`) mod 20: 0 drops, 1 empties, 2 loses its `[.!?]`, 3 repeats, 4 becomes the user's. Nulls: one space."""
    filled = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return filled.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
