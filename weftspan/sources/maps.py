"""Dimension maps as small frames and as in-row expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspan.plans.sizing import bounded_map


def head_map(spark: SparkSession, heads: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """(head, position, nic2), one row per head and division; empty heads drop."""
    rows = [(h, i, list(d)) for i, (h, d) in enumerate(heads)]
    frame = bounded_map(spark, rows, "head string, position int, nic2 array<string>")
    return F.broadcast(frame.select("head", "position", F.explode("nic2").alias("nic2")))


def range_map(spark: SparkSession, ranges: Sequence[tuple[str, int, int]]) -> DataFrame:
    """(div, key): half-open ranges spelled out, so lookup is an equi-join.

    A value inside two ranges belongs to the one listed first.
    """
    owner: dict[int, str] = {}
    for key, low, high in ranges:
        for value in range(low, high):
            owner.setdefault(value, key)
    return bounded_map(spark, sorted(owner.items()), "div int, key string")


def activity_map(spark: SparkSession, activities) -> DataFrame:
    """(label, value, div): value added per activity, one row per division."""
    rows = [
        (label, value, div)
        for label, value, ranges in activities
        for low, high in ranges
        for div in range(low, high)
    ]
    return bounded_map(spark, rows, "label string, value bigint, div int")


def in_range(div: Column, ranges: Sequence[tuple[str, int, int]]) -> Column:
    """Range lookup inside the row: first listed range wins, gaps give null.

    The ranges become one array with a place per integer, so the value is
    computed once per row and looked up by position.
    """
    places: list[str | None] = [None] * max(high for _, _, high in ranges)
    for key, low, high in ranges:
        for value in range(low, high):
            places[value] = places[value] or key
    texts = ["cast(null as string)" if p is None else _quoted(p) for p in places]
    return F.get(F.expr(f"array({', '.join(texts)})"), div.cast("int"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(mapping: Mapping[str, str]) -> Column:
    """Map literal, stated as one expression (one call however long the map)."""
    return F.expr("map(" + ", ".join(_quoted(x) for item in mapping.items() for x in item) + ")")


def literal_array(values: Sequence[str]) -> Column:
    return F.expr("array(" + ", ".join(_quoted(v) for v in values) + ")")


def recode(c: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Dictionary recode; values not listed become null or the default."""
    found = F.try_element_at(literal_map(mapping), c)
    return found if default is None else F.coalesce(found, default)


def in_sets(c: Column, sets: Sequence[tuple[str, Sequence[int]]]) -> Column:
    """Label of the first set that holds the value; null when none does."""
    out = F.lit(None).cast("string")
    for label, codes in reversed(sets):
        out = F.when(c.isin(list(codes)), F.lit(label)).otherwise(out)
    return out
