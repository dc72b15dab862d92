"""Parsing of sets kept in strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_ints(c: Column) -> Column:
    """Sorted distinct positive whole numbers of a CSV string; empty means no constraint."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda n: n > 0)))


def csv_of(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda n: n.cast("string")), ",")


def json_strings(c: Column) -> Column:
    """Strings of a JSON array; null when the text is not a JSON array."""
    return F.from_json(c, "array<string>")
