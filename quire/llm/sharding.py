"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The key of a row is its id; the key and the number of shards decide the shard, without a table of the ring. When a
shard is appended, each row stays where it is or moves into the new shard, with probability 1 / (shards + 1).

Defined cases: a null id is a key like any other; a null text has no bytes; rows of equal id go to one shard; the
slots of a shard are numbered without gaps from 0, whatever ties there are; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import small_batches

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Blocks into which the rows of a shard are dealt while they are numbered.
BLOCKS = 256


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys, all at once: a key leaves the loop when its next jump would pass the last shard."""
    if shards < 1:
        raise ValueError("there must be a shard")
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), dtype=np.int64)
    active = np.arange(len(state))
    while len(active):
        state = state * np.uint64(2862933555777941757) + np.uint64(1)
        jump = ((at[active] + 1) * (float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = jump < shards
        active, state = active[on], state[on]
        at[active] = jump[on]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key column."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return shard(key)


def row_key(id_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def with_shard(docs: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """docs with its shard, in one pass without a shuffle. An input column of that name is replaced."""
    small_batches(docs.sparkSession)
    return docs.withColumn(name, shard_of(row_key(id_col), shards))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", shards: int = SHARDS, name: str = "shard") -> None:
    """Writes a folder shard=k for each shard; each task writes what it has, so no shard passes through one task."""
    with_shard(docs, id_col, shards, name).write.partitionBy(name).parquet(path)


def layout(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot (its number within the shard) and grown_shard (with one shard more).

    Rows alike in all of this are counted first, for each input partition, and numbered together. A shard's rows are dealt into blocks by hash; the
    blocks' counts (at most shards * BLOCKS rows) give each block its first slot, and each block is numbered on its own.
    """
    small_batches(docs.sparkSession)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    alike = rows.withColumn("part", F.spark_partition_id()).groupBy("id", "size", "crc", "part").agg(F.count("*").alias("n"))
    key = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")))
    alike = alike.withColumn("key", key).withColumn("shard", shard_of(F.col("key"), shards)).withColumn("grown", shard_of(F.col("key"), shards + 1))
    alike = alike.withColumn("block", F.pmod(F.xxhash64("id", "size", "crc", "part"), F.lit(BLOCKS)).cast("int"))
    in_block = Window.partitionBy("shard", "block").orderBy("id", "size", "crc", "part")
    placed = alike.withColumn("first", F.sum("n").over(in_block) - F.col("n"))
    counts = alike.groupBy("shard", "block").agg(F.sum("n").alias("rows"))
    counts = counts.withColumn("before", F.sum("rows").over(Window.partitionBy("shard").orderBy("block")) - F.col("rows")).drop("rows")
    placed = placed.join(F.broadcast(counts), ["shard", "block"])  # at most shards * BLOCKS rows
    placed = placed.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("first") + F.col("offset")).alias("slot"), F.col("grown").alias("grown_shard"))
