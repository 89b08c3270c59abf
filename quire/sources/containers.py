"""Reads container files and decodes them: one row per inflated member, and one per file."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.kernels import envelope, fragments, inflate, segments
from quire.model import DECODED, Limits

#: Bytes of files that a worker is handed at once, and rows and member bytes of a batch that it gives back.
BATCH_BYTES, BATCH_FILES, OUT_BYTES = 64 << 20, 64, 16 << 20


def read(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """(file_id, extension, file_size, content) of the files at the paths; an explicit path of any extension is read.

    Spark's reader has no row for a file of zero bytes; such rows of other tables of files are told apart by split_empty.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return files_of(reader.load(list(paths)))


def files_of(df: DataFrame) -> DataFrame:
    """Shapes rows of the binaryFile source, batch or streaming."""
    name = plain_path(F.col("path"))
    return df.select(name.alias("file_id"), extension(name).alias("extension"), F.col("length").alias("file_size"), "content")


def plain_path(path: Column) -> Column:
    """The path without a leading file: scheme."""
    return F.regexp_replace(path, "^file:(//)?", "")


def extension(path: Column) -> Column:
    """The lower-cased extension; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def split_empty(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with content, and errors (file_id, error) for those without."""
    empty = F.coalesce(F.length("content"), F.lit(0)) == 0
    return files.where(~empty), files.where(empty).select("file_id", F.lit("the file is empty").alias("error"))


def _envelope(data: bytes) -> dict:
    try:
        index = envelope.read(data)
    except envelope.EnvelopeError as e:
        return {"outcome": "unreadable", "reason": str(e)}
    return {
        "outcome": "decoded",
        "blobs": [{"blob_id": k, "path": index.paths.get(k), "start": b.start, "len": b.len} for k, b in sorted(index.blobs.items())],
        "paths": len(index.paths),
        "channels": [{"channel_id": k, "package": v} for k, v in sorted(index.channels.items())],
        "handles": [{"name": k, "url": v} for k, v in sorted(index.handles.items())],
        "deltas": index.deltas,
        "snapshot_seq": index.snapshot_seq,
        "first_delta_seq": index.first_delta_seq,
    }


def _payload(data: bytes, p: fragments.Payload, with_values: bool) -> dict:
    from hashlib import sha256

    package = p.value.get("package")
    name = package.get("name") if isinstance(package, dict) else None
    version = package.get("version") if isinstance(package, dict) else None
    out = {"start": p.start, "end": p.end, "anchor": p.anchor, "has_package": isinstance(name, str), "package_name": name if isinstance(name, str) else None, "package_version": version if isinstance(version, str) else None}
    if with_values:
        out["value"] = segments.strictjson.dumps(p.value)
    chunk = segments.chunk(p.value)
    if chunk is not None:
        out["chunk"] = {"payload_offset": p.start, "sha256": sha256(data[p.start : p.end]).hexdigest(), **chunk}
    return out


def decode_file(file_id: str, content: bytes, limits: Limits = Limits(), discovery: str = "fragment", with_data: bool = False, with_values: bool = False) -> Iterator[dict]:
    """The rows (DECODED) of one file. A member that can't be understood costs only its own payloads."""
    from hashlib import sha256

    found = inflate.scan(content, limits)
    warnings = found.warnings + [{"code": "gzip_candidate_rejected", "message": f"gzip signature did not inflate: {error}", "member_index": None, "file_offset": at, "rejected": True} for at, error in found.failed]
    for m in found.members:
        index, own = _envelope(m.data), []
        if index["outcome"] == "unreadable" and b"treeNodes" in m.data:
            text = f"framing of this member is unreadable ({index['reason']}); its trees are told apart by their contents"
            own.append({"code": "envelope_unreadable", "message": text, "member_index": m.index, "file_offset": m.file_offset, "rejected": False})
        finder = fragments.DISCOVERIES[discovery](**({"limits": limits} if discovery == "fragment" else {}))
        try:
            payloads = finder.discover(m.data)
        except ValueError as e:
            own.append({"code": "payload_discovery_failed", "message": str(e), "member_index": m.index, "file_offset": m.file_offset, "rejected": False})
            payloads = []
        yield {
            "file_id": file_id, "member_index": m.index, "file_offset": m.file_offset, "compressed_len": m.compressed_len, "data": m.data if with_data else None, "data_len": len(m.data),
            "utf8": _is_utf8(m.data), "truncated": m.truncated, "partial": m.partial, "sha256": sha256(m.data).hexdigest(), "envelope": index,
            "payloads": [_payload(m.data, p, with_values) for p in payloads], "warnings": own,
        }
    yield {"file_id": file_id, "file_size": len(content), "candidates": len(found.candidates), "failed": [{"file_offset": at, "error": e} for at, e in found.failed], "warnings": warnings}


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def in_batches(rows: Iterable[dict], schema: pa.Schema, size: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    """Record batches of up to BATCH_FILES rows, or of fewer that come to OUT_BYTES by size."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) >= BATCH_FILES or total >= OUT_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def decode(files: DataFrame, limits: Limits = Limits(), discovery: str = "fragment", with_data: bool = False, with_values: bool = False) -> DataFrame:
    """DECODED rows of (file_id, content). One pass without a shuffle; a worker holds one file's members at a time."""
    spark = files.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    schema = to_arrow_schema(DECODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(batch.column(0), batch.column(1))
            rows = (row for file_id, content in files for row in decode_file(file_id.as_py(), content.as_py() or b"", limits, discovery, with_data, with_values))
            yield from in_batches(rows, schema, lambda row: row.get("data_len") or 0)

    return files.select("file_id", "content").mapInArrow(run, DECODED)
