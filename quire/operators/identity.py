"""What a file is: components, assessment, property usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.properties import property_class
from quire.model import FORMAT_COMPATIBLE, FORMAT_EMPTY, FORMAT_HIGH, FORMAT_KNOWN_EMPTY, FORMAT_NONE, KNOWN_COMPONENTS


def components(packages: DataFrame, by: str = "file_id", name: str = "name", version: str = "version") -> DataFrame:
    """(key, components): the distinct (name, version), by name, then version with null first."""
    pairs = F.collect_set(F.struct(F.col(name).alias("name"), F.col(version).alias("version")))
    return packages.groupBy(by).agg(F.array_sort(pairs).alias("components"))


def is_known(names: Column) -> Column:
    return F.coalesce(F.arrays_overlap(names, F.array(*[F.lit(x) for x in KNOWN_COMPONENTS])), F.lit(False))


def assess(members: Column, payloads: Column, chunks: Column, known: Column) -> Column:
    """(format, confidence) by what was found."""

    def label(text: str, confidence: str) -> Column:
        return F.struct(F.lit(text).alias("format"), F.lit(confidence).alias("confidence"))

    structural = (members > 0) & (payloads > 0)
    return (
        F.when(~structural, label(FORMAT_NONE, "none"))
        .when((chunks > 0) & known, label(FORMAT_HIGH, "high"))
        .when(chunks > 0, label(FORMAT_COMPATIBLE, "moderate"))
        .when(known, label(FORMAT_KNOWN_EMPTY, "moderate"))
        .otherwise(label(FORMAT_EMPTY, "low"))
    )


def property_usage(keys: DataFrame, by: str = "file_id", key: str = "key") -> DataFrame:
    """(file, key, class, occurrences)."""
    return keys.groupBy(by, key).agg(F.count("*").alias("occurrences")).withColumn("class", property_class(F.col(key)))


def payload_counts(payloads: DataFrame, by: str = "file_id", anchor: str = "anchor") -> DataFrame:
    return payloads.groupBy(by, anchor).agg(F.count("*").alias("n"))
