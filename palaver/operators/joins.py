"""Joins with a table of keys in which some keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is heavy; there are fewer than 1 / share of them, whatever the input.
HEAVY = 1000


def heavy_keys(rows: DataFrame, on: str) -> DataFrame:
    """(on): the keys with more than a thousandth of the rows, fewer than a thousand; counts are partial before they meet."""
    counts = rows.groupBy(on).agg(F.count("*").alias("_n"))
    total = rows.count()
    return counts.where(F.col("_n") * HEAVY > total).select(on)


def look_up(rows: DataFrame, keys: DataFrame, on: str, heavy: DataFrame) -> DataFrame:
    """``rows`` inner joined with ``keys`` (unique in ``on``): rows of heavy keys stay where they are, their keys are broadcast."""
    few = F.broadcast(heavy)
    light = rows.join(few, on, "left_anti").join(keys, on)
    return rows.join(F.broadcast(keys.join(few, on, "left_semi")), on).unionByName(light)
