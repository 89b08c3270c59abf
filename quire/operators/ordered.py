"""Ordered operators on rows that belong to a file (or any other key): copies, gaps, runs, first matches, intervals.

Each takes the columns to work by, so that the container pipeline and other tables share them. All of them need the rows
of one key together; a key is one file, whose size the decoder bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark_copies(df: DataFrame, by: Sequence[str], order: Sequence[str], digest: str) -> DataFrame:
    """Adds kept (first of the rows that claim one place), duplicate (a later one) and conflict (a later one that differs)."""
    w = Window.partitionBy(*by).orderBy(*order)
    kept = F.row_number().over(w) == 1
    same = F.col(digest) == F.first(digest).over(w)
    return df.withColumns({"kept": kept, "duplicate": ~kept, "conflict": ~same})


def mark_gaps(df: DataFrame, by: Sequence[str], start: str, size: str) -> DataFrame:
    """Adds expected (where the row should start, were there no gap or overlap) and gap."""
    w = Window.partitionBy(*by).orderBy(start)
    expected = F.lag(F.col(start) + F.col(size), 1, 0).over(w)
    return df.withColumn("expected", expected).withColumn("gap", F.col(start) != F.col("expected"))


def number_runs(df: DataFrame, by: Sequence[str], order: str, ends: Column, name: str = "run") -> DataFrame:
    """Numbers runs in which each row with `ends` closes the run that it stands in."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(ends.cast("long")).over(before), F.lit(0)))


def number_islands(df: DataFrame, by: Sequence[str], order: str, value: Column, joins: Column | None = None, name: str = "island") -> DataFrame:
    """Numbers runs of neighbours with an equal value (nulls are equal); joins, if given, must hold for a row to join its neighbour."""
    w = Window.partitionBy(*by).orderBy(order)
    new = ~value.eqNullSafe(F.lag(value).over(w)) | F.row_number().over(w).eqNullSafe(1)
    if joins is not None:
        new = new | ~joins
    return df.withColumn("_new", new.cast("long")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def first_occurrences(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The first row of each value within a key."""
    w = Window.partitionBy(*by, value).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def locate(points: DataFrame, ranges: DataFrame, by: Sequence[str], offset: str, start: str, length: str, range_id: str) -> DataFrame:
    """Every point with the range that holds its offset, or nulls; of several, the least range_id counts. point columns, then those of ranges.

    Each different (key, offset) is looked up once, so points may repeat and none is lost.
    """
    places = points.select(*by, offset).distinct().join(ranges, list(by)).where((F.col(offset) >= F.col(start)) & (F.col(offset) < F.col(start) + F.col(length)))
    own = [c for c in ranges.columns if c not in by]
    found = places.groupBy(*by, offset).agg(F.min_by(F.struct(*own), range_id).alias("_range"))
    return points.join(found, [*by, offset], "left").select(*points.columns, "_range.*")


def first_by(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """One row per key: the value at the least order."""
    return df.groupBy(*by).agg(F.min_by(value, order).alias(value))
