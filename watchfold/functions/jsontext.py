"""JSON text in the spaced layout that evidence payloads use."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from watchfold.functions.hashing import canonical_json


def json_scalar(value: Column) -> Column:
    """A string column as a JSON string or null."""
    text = canonical_json({"v": value})
    return F.substring(text, F.lit(6), F.length(text) - 6)


def json_list(values: Column) -> Column:
    """An array of strings as a JSON list with a space after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, _element), ", "), F.lit("]"))


def _element(v: Column) -> Column:
    text = F.to_json(F.struct(v.alias("v")))
    return F.substring(text, F.lit(6), F.length(text) - 6)


def spaced_object(fields: dict[str, Column]) -> Column:
    """``{"a": ..., "b": ...}`` from columns that already hold JSON text."""
    parts: list[Column] = []
    for i, (name, value) in enumerate(fields.items()):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{name}": '), value]
    return F.concat(*parts, F.lit("}"))


def uuid_form(hex_text: Column) -> Column:
    """The first 32 hex digits of a hash, written as a UUID."""
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hex_text, start, n) for start, n in cut])


def is_one_json(text: Column) -> Column:
    """Whether a text is exactly one JSON value, nothing after it; null text is not."""
    whole = F.concat(F.lit("["), text, F.lit("]"))
    return F.coalesce(F.try_parse_json(whole).isNotNull() & (F.json_array_length(whole) == 1), F.lit(False))
