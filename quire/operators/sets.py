"""Set-like operators: presence in another table, copies by digest, exploded parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def having(df: DataFrame, other: DataFrame, on: Sequence[str], present: bool = True) -> DataFrame:
    """The rows whose key is present (or absent) in another table."""
    return df.join(other.select(*on), list(on), "left_semi" if present else "left_anti")


def count_copies(df: DataFrame, digest: str, order: str) -> DataFrame:
    """(digest, copies, first): pre-aggregated before the shuffle, so that a digest of any number of rows costs one row a task."""
    return df.groupBy(digest).agg(F.count("*").alias("copies"), F.min(order).alias("first"))


def parts_of(df: DataFrame, key: str, array: str, part: str = "part") -> DataFrame:
    """(key, pos, part): the elements of an array with their places."""
    return df.select(key, F.posexplode(array).alias("pos", part))
