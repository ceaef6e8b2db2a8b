"""JSON access with defaults, and building JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def opt(json: Column, path: str, kind: str = "string", default=None) -> Column:
    """The value at a path, cast; the default where it is missing or of another kind."""
    found = F.get_json_object(json, f"$.{path}").try_cast(kind)
    return F.coalesce(found, F.lit(default).cast(kind)) if default is not None else found


def has(json: Column, path: str) -> Column:
    return F.get_json_object(json, f"$.{path}").isNotNull()


def keys(json: Column) -> Column:
    return F.json_object_keys(json)


def build(**fields: Column) -> Column:
    """A JSON object; null fields are left out."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def parse(json: Column) -> Column:
    """JSON text as a tree (variant); null where it is no JSON."""
    return F.try_parse_json(json)


def get(tree: Column, path: str, kind: str = "string", default=None) -> Column:
    """The value at a path of a tree as the kind asked for, which may be array<variant> or map<string,variant>; the default
    where it is missing or can't be that."""
    found = F.try_variant_get(tree, f"$.{path}" if path else "$", kind)
    return F.coalesce(found, F.lit(default).cast(kind)) if default is not None else found


def kind_of(tree: Column, path: str = "") -> Column:
    """OBJECT, ARRAY, BIGINT, STRING, ... of the value at a path; VOID for JSON's null, null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(tree, f"$.{path}" if path else "$", "variant")), r"^([A-Z]+)", 1)


def with_element(tree: Column, path: str, value: Column) -> Column:
    """The array at a path of a tree, as JSON text, with one more tree at its end; null where there is no array."""
    return F.to_json(F.concat(get(tree, path, "array<variant>"), F.array(value)))


def pretty(tree: Column) -> Column:
    """An object as JSON text with a line a field, fields in order of name; null for what is no object."""
    return F.to_json(get(tree, "", "map<string,variant>"), {"pretty": "true"})


def accumulate(a: Column, b: Column) -> Column:
    """Two values of a key as one JSON value: the value alone if it is the only one, else an array of both."""
    both = F.filter(F.array(a, b), lambda x: x.isNotNull())
    return F.when(F.size(both) == 1, F.get(both, F.lit(0))).when(F.size(both) > 1, F.concat(F.lit("["), F.array_join(both, ","), F.lit("]")))


def append(array: Column, value: Column) -> Column:
    """A JSON array (null: none yet) with one more JSON value at its end; null where the first is no array.

    The text before it stays as it is written; with_element() does the same to a tree.
    """
    inner = F.trim(F.regexp_extract(array, r"(?s)^\s*\[(.*)\]\s*$", 1))
    grown = F.when(inner == "", F.concat(F.lit("["), value, F.lit("]"))).otherwise(F.concat(F.lit("["), inner, F.lit(","), value, F.lit("]")))
    return F.when(array.isNull(), F.concat(F.lit("["), value, F.lit("]"))).when(F.json_array_length(array).isNotNull(), grown)
