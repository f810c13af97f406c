"""Text and record cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def strip_prefix(text: Column, prefix: str) -> Column:
    """Drop one leading ``prefix``, then surrounding blanks."""
    return F.trim(F.regexp_replace(text, "^" + re.escape(prefix), ""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def count_field(text: Column) -> Column:
    """Missing or empty is 0; text that is no whole number is NULL."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.lit(0)).when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))


def degree_field(text: Column) -> Column:
    """Coordinate; missing, empty and 0 all mean unknown."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.nullif(t.try_cast("double"), F.lit(0.0))


def is_number_or_blank(text: Column, kind: str) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    if kind == "int":
        return (t == "") | t.rlike(r"^[+-]?\d+$")
    return (t == "") | t.try_cast("double").isNotNull()


def damaged_name(name: Column) -> Column:
    """A lossy export left a question mark in the name."""
    return F.contains(name, F.lit("?"))


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group)


def relabel(value: Column, mapping: dict[str, str]) -> Column:
    """Replace the listed values, keep the others."""
    if not mapping:
        return value
    pairs = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return F.coalesce(F.element_at(pairs, value), value)


def as_json(*cols: str) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
