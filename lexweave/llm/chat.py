"""Chat formatting with typed content parts (operator 4)."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, map_batches

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: What must not stand in a text unescaped: the opening of this template's marks, and marks of other well-known templates.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_MUST = re.compile("|".join(map(re.escape, [*CONTROLS, "\\"])))
_MARKED = re.compile(r"\\(\\?)")
_SEGMENT = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.DOTALL)

PART = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("type", T.StringType()), ("text", T.StringType()), ("ref", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("seconds", T.DoubleType()), ("pages", T.IntegerType()))]))


def escape(text: str) -> str:
    """A backslash is doubled; a control string gets one after its first character."""
    return _MUST.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1", text)


class PartVisitor:
    """Flattens a turn's content parts, in order, into text with placeholders.

    Text parts with nothing but text between them are one text and escaped as one, so that no control string comes about where
    parts meet. A placeholder and a text beside it can't form one either: it opens with what must not stand in texts, and no
    control string goes on with what it ends in.
    Collects references of attachments with their places in the content, and how many tokens the parts expand to: an image
    by tiles of ``tile`` pixels, audio by its length, a document by its pages; text by ``chars_per_token``.
    """

    def __init__(self, tile: int = 512, tile_tokens: int = 170, base_tokens: int = 85, audio_rate: float = 25.0, page_tokens: int = 600, chars_per_token: float = 4.0):
        self.tile, self.tile_tokens, self.base_tokens, self.audio_rate, self.page_tokens, self.chars_per_token = tile, tile_tokens, base_tokens, audio_rate, page_tokens, chars_per_token

    def flatten(self, parts: list[dict[str, Any]] | None) -> tuple[str, list[dict[str, Any]], int]:
        self.out: list[str] = []
        self.texts: list[str] = []  # parts since the last placeholder
        self.attachments: list[dict[str, Any]] = []
        self.length = self.tokens = 0
        for part in parts or []:
            if part is not None:
                getattr(self, f"visit_{part['type'] or 'text'}", self.visit_unknown)(part)
        self.end_text()
        return "".join(self.out), self.attachments, self.tokens

    def add(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def end_text(self) -> None:
        self.add(escape("".join(self.texts)))
        self.texts = []

    def attach(self, part: dict[str, Any], tokens: int) -> None:
        self.end_text()
        self.attachments.append({"type": part["type"], "ref": part["ref"], "place": self.length, "tokens": tokens})
        self.add(f"<|{part['type']}:{len(self.attachments) - 1}|>")
        self.tokens += tokens

    def visit_text(self, part: dict[str, Any]) -> None:
        text = part["text"] or ""
        self.texts.append(text)
        self.tokens += math.ceil(len(text) / self.chars_per_token)

    def visit_image(self, part: dict[str, Any]) -> None:
        tiles = math.ceil((part["width"] or self.tile) / self.tile) * math.ceil((part["height"] or self.tile) / self.tile)
        self.attach(part, self.base_tokens + self.tile_tokens * tiles)

    def visit_audio(self, part: dict[str, Any]) -> None:
        self.attach(part, math.ceil((part["seconds"] or 0.0) * self.audio_rate))

    def visit_document(self, part: dict[str, Any]) -> None:
        self.attach(part, self.page_tokens * (part["pages"] or 1))

    def visit_unknown(self, part: dict[str, Any]) -> None:
        raise ValueError(f"no content part of type {part['type']!r}")


FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("attachments", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("tokens", T.IntegerType())]))),
        T.StructField("tokens", T.LongType()),
    ]
)


def text_parts(column: str = "text"):
    """Plain text as a single text part."""
    empty = {f.name: F.lit(None).cast(f.dataType) for f in PART.elementType}
    filled = empty | {"type": F.lit("text"), "text": F.coalesce(F.col(column), F.lit(""))}
    return F.array(F.struct(*(c.alias(n) for n, c in filled.items())))


def format_turns(df: DataFrame, parts_col: str = "parts", trained: tuple[str, ...] = ("assistant",), **settings: Any) -> DataFrame:
    """Formats each row (conv_id, turn, role, parts) for itself; a conversation is its turns' segments in order.

    Returns conv_id, turn, formatted, loss (spans of ``formatted`` that are trained on: the whole content of turns whose
    role is in ``trained``), attachments (type, ref, place in ``formatted``, tokens) and tokens after expansion.
    Texts of any length are formatted whole, a slice of rows at a time. A null role is empty; null parts and null texts are empty content; null ids and turns stay null; repeated rows give a
    segment each; an empty table gives no rows; other columns are ignored. A part of unknown type is an error.
    """
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col(parts_col).cast(PART).alias("parts"))

    def run(batch: pa.RecordBatch) -> dict:
        visitor, out = PartVisitor(**settings), []
        for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            head = f"{TURN}{escape(role or '')}{BODY}"
            content, attachments, tokens = visitor.flatten(parts)
            loss = [{"start": len(head), "end": len(head) + len(content)}] if role in trained else []
            out.append((head + content + END, loss, [a | {"place": a["place"] + len(head)} for a in attachments], tokens))
        loss_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        attachment_type = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("place", pa.int32()), ("tokens", pa.int32())]))
        types = [pa.string(), loss_type, attachment_type, pa.int64()]
        return {"conv_id": batch.column(0), "turn": batch.column(1)} | {n: pa.array([r[i] for r in out], types[i]) for i, n in enumerate(("formatted", "loss", "attachments", "tokens"))}

    names = FORMATTED.names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = run(batch.slice(at, SLICE))
                yield pa.RecordBatch.from_pydict({n: out[n] for n in names})

    return map_batches(rows, each, FORMATTED)


def read_segment(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stay as they are."""
    role, content = _SEGMENT.fullmatch(formatted).groups()
    return unescape(role), unescape(content)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Reads formatted turns back and sums up each conversation: DIGEST, from its segments in order of turn.

    Segments stream through in order and only running hashes are kept, however long a conversation is. Turns of equal
    number are ordered by their formatted text, null turns come first.
    """
    columns = formatted.select("conv_id", "turn", "formatted", "loss")
    dealt = columns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []

        def close() -> None:
            n, turns, chars, loss, size = state
            out.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])
            out.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                for conv_id, text, loss in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True):
                    if state is None or conv_id != current:
                        if state is not None:
                            close()
                        current, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    role, content = read_segment(text)
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode("utf-8", "replace"))
                    for span in loss:
                        under = unescape(text[span["start"] : span["end"]])
                        state[2] += len(under)
                        state[3].update(under.encode("utf-8", "replace"))
                    state[4] += len(text)
                if out:
                    yield flush()
        if state is not None:
            close()
            yield flush()

    return map_batches(dealt, run, DIGEST)
