"""Columns that are computed once although later expressions use them many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row ``inline``.

    Spark merges neighbouring projections, which repeats a costly expression, even a
    Python call, at each of its uses. It does not merge across a generator.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` inside one expression, with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)
