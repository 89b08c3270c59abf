"""What leaves the engine: JSON documents, inspect reports, payload dumps and written files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.kernels import jsonout, strictjson
from quire.plans.analysis import Analysis


def _per_file(rows: DataFrame, build: Callable[[dict[str, Any]], str]) -> DataFrame:
    """(file_id, rendered): one Python call per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array([build(r) for r in batch.to_pylist()], pa.string())], ["file_id", "rendered"])

    return rows.mapInArrow(run, "file_id string, rendered string")


def _gathered(df: DataFrame, name: str, *columns: Any) -> DataFrame:
    return df.groupBy("file_id").agg(F.collect_list(F.struct(*columns)).alias(name))


def _trees(a: Analysis) -> DataFrame:
    return _gathered(a.trees.withColumn("assembled_segments", F.size("segments").cast("long")), "trees", "tree_index", "key", "role", "role_evidence", "location", "content_hash", "assembled_segments", "chunks", "complete", "duplicate_copies", "sources", "evidence")


def _base(a: Analysis) -> DataFrame:
    """What documents and reports share."""
    d = a.documents.join(a.assessment, "file_id").join(_trees(a), "file_id", "left")
    d = d.join(_gathered(a.properties, "properties", "key", "class", "occurrences"), "file_id", "left")
    return d.join(a.warnings.withColumnRenamed("warnings", "analysis_warnings"), "file_id", "left")


def json_documents(a: Analysis, include_attribution: bool = False) -> DataFrame:
    """(file_id, rendered) of recognised files: the document model with its diagnostics. Personal data is left out unless asked for."""
    blocks = _gathered(a.blocks, "blocks", "block_index", "kind", "level", "depth", "list_id", "node_type", "inlines", "props", "raw")
    rows = _base(a).where("confidence != 'none'").join(blocks, "file_id", "left")
    return _per_file(rows, lambda r: jsonout.document(r, include_attribution))


def reports(a: Analysis, form: str = "json", verbose: bool = False) -> DataFrame:
    """(file_id, rendered) of every file with content: the inspect report, as json or text."""
    from quire.operators import oplog

    names = [F.col("member_index").alias("index"), "file_offset", "compressed_len", F.col("data_len").alias("decompressed_len"), F.col("utf8").alias("is_utf8"), "truncated", "partial", "sha256", "json_payloads", "merge_tree_chunks", "envelope"]
    body = a.bodies.select("file_id", F.when(F.col("text_segments") > 0, F.size("body_segments")).otherwise(0).cast("long").alias("snapshot_body_segments"))
    counts = oplog.counts(a.ops).select("file_id", F.struct("records", "inserts", "removes", "annotates", "unknown").alias("op_counts"))
    rows = _base(a).join(a.scans.select("file_id", "failed"), "file_id").join(_gathered(a.members, "member_rows", *names), "file_id", "left")
    for extra in (_gathered(a.payloads_by_anchor, "anchors", "anchor", "n"), _gathered(a.inserts.select("file_id", "address", F.col("inserts"), "rank"), "inserts", "address", "inserts", "rank"), counts, a.follows, body):
        rows = rows.join(extra, "file_id", "left")
    from quire.sources.containers import extension

    rows = rows.withColumn("extension", extension(F.col("file_id"))).na.fill(0, ["snapshot_body_segments"])

    def build(r: dict[str, Any]) -> str:
        got = jsonout.report(r)
        return strictjson.pretty(got) if form == "json" else jsonout.report_text(got, verbose)

    return _per_file(rows, build)


def dump(a: Analysis) -> DataFrame:
    """(file_id, name, content): each inflated member verbatim and each payload as pretty JSON, under names that stay the same between runs. Needs an Analysis with data and values."""
    raw = a.members.select("file_id", F.format_string("member-%03d.raw", "member_index").alias("name"), F.col("data").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [strictjson.pretty(strictjson.loads(v)).encode() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.binary())], ["file_id", "name", "content"])

    parts = a.payloads.select("file_id", F.format_string("member-%03d-fragment-%03d.json", "member_index", "ordinal").alias("name"), "value")
    return raw.unionByName(parts.mapInArrow(run, "file_id string, name string, content binary"))


def write_rendered(rendered: DataFrame, path: str) -> None:
    """Writes (file_id, rendered) as Parquet: one row per file, by all executors at once."""
    rendered.write.mode("overwrite").parquet(path)


def diagnostics(a: Analysis) -> DataFrame:
    """(file_id, stage, ordinal, code, message, ...): the analysis' warnings, then those of reconstruction."""
    one = a.warnings.select("file_id", F.lit(0).alias("stage"), F.posexplode("warnings").alias("ordinal", "w"))
    two = a.documents.select("file_id", F.lit(1).alias("stage"), F.posexplode("warnings").alias("ordinal", "w"))
    return one.unionByName(two).select("file_id", "stage", "ordinal", "w.*")
