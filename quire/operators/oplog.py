"""Operation logs as tables: distinct deltas, operations, counts, ranking, target choice and replay."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions import text as fx
from quire.kernels import oplog
from quire.model import OPERATION, PACKAGE_BODY, SEGMENTS
from quire.operators.ordered import first_by, first_occurrences
from quire.sources.containers import in_batches


def deltas_of(decoded: DataFrame) -> DataFrame:
    """(file_id, member_index, ordinal, raw): each message at its first occurrence in the file."""
    rows = decoded.where(F.col("member_index").isNotNull()).select("file_id", "member_index", F.posexplode("envelope.deltas").alias("ordinal", "raw"))
    return first_occurrences(rows, ["file_id"], "raw", ["member_index", "ordinal"])


def operations(deltas: DataFrame) -> DataFrame:
    """(file_id, op_ordinal, channel, ...): all operations of a file's deltas in order; a file's log is read by one task."""
    in_order = F.array_sort(F.collect_list(F.struct("member_index", "ordinal", "raw")))
    logs = deltas.groupBy("file_id").agg(F.transform(in_order, lambda x: x["raw"]).alias("raw"))
    schema = T.StructType([T.StructField("file_id", T.StringType()), *OPERATION.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield from in_batches(({"file_id": file_id, **op} for file_id, raw in files for op in oplog.operations(raw)), arrow, lambda op: 1024 * len(op["segments"] or []))

    return logs.mapInArrow(run, schema).withColumn("address", fx.address(F.col("channel"), F.col("data_structure")))


def follows(snapshot: Column, first: Column) -> Column:
    """The log begins where the snapshot ends."""
    return F.coalesce(first == snapshot + 1, F.lit(False))


def follows_snapshot(rows: DataFrame, by: str, snapshot: str, first: str) -> DataFrame:
    """(key, follows): every row of the key follows its snapshot."""
    return rows.groupBy(by).agg(F.min(follows(F.col(snapshot), F.col(first))).alias("follows"))


def counts(ops: DataFrame, by: str = "file_id", kind: str = "kind") -> DataFrame:
    """(key, records, inserts, removes, annotates, unknown)."""
    return ops.groupBy(by).agg(F.count("*").alias("records"), *[F.count(F.when(F.col(kind) == k, 1)).alias(f"{k}s" if k != "unknown" else k) for k in ("insert", "remove", "annotate", "unknown")])


def inserts_by_address(ops: DataFrame, by: str = "file_id", address: str = "address", kind: str = "kind") -> DataFrame:
    """(key, address, inserts, rank): most inserts first, then by address."""
    n = ops.where(F.col(kind) == "insert").groupBy(by, address).agg(F.count("*").alias("inserts"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("inserts"), address)))


def choose_target(ranked: DataFrame, by: str = "file_id", package: str = "package") -> DataFrame:
    """The address to replay: the first that the body's package owns, else the first; adds confirmed and n_addresses."""
    w = Window.partitionBy(by)
    confirmed = F.coalesce(F.col(package) == PACKAGE_BODY, F.lit(False))
    first = F.row_number().over(w.orderBy(~confirmed, "rank"))
    return ranked.withColumns({"confirmed": confirmed, "n_addresses": F.count("*").over(w), "_n": first}).where("_n = 1").drop("_n")


def channel_packages(decoded: DataFrame) -> DataFrame:
    """(file_id, channel, package): by the first member that knows the channel."""
    rows = decoded.where(F.col("envelope.outcome") == "decoded").select("file_id", "member_index", F.explode("envelope.channels").alias("c"))
    return first_by(rows.select("file_id", "member_index", F.col("c.channel_id").alias("channel"), "c.package"), ["file_id", "channel"], "package", "member_index")


REPLAYED = T.StructType([T.StructField("segments", SEGMENTS), T.StructField("applied", T.LongType()), T.StructField("skipped", T.LongType()), T.StructField("warnings", T.ArrayType(T.StringType()))])


def replay(logs: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, segments, applied, skipped, warnings) of rows (key, base segments, ops in order). Operations depend on all before them, so a log is replayed by one task; logs are spread over tasks."""
    kind = logs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *REPLAYED.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = ((k, oplog.replay(base or [], ops or [])) for k, base, ops in zip(*(batch.column(i).to_pylist() for i in range(3))))
            yield from in_batches(({key: k, "segments": r.segments, "applied": r.applied, "skipped": r.skipped, "warnings": r.warnings} for k, r in logs), arrow, lambda r: 1024 * len(r["segments"]))

    return logs.select(key, "base", "ops").mapInArrow(run, schema)


def log_of(ops: DataFrame, by: str = "file_id", order: str = "op_ordinal") -> DataFrame:
    """(key, ops): the operations of each key as one array in order."""
    fields = [order, "kind", "pos1", "pos2", "segments"]
    return ops.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ops"))


