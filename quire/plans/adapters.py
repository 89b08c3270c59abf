"""Shapes other tables to the input of the container operators, and encodes documents into containers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.kernels import writer
from quire.kernels.segments import segment
from quire.model import KNOWN_COMPONENTS, PACKAGE_BODY, PACKAGE_TITLE, SEGMENT


def text_segment(text: Column) -> Column:
    """A plain text as a segment column."""
    own = {"kind": F.lit("text"), "text": text, "props": F.lit("{}"), "keys": F.array().cast("array<string>"), "attributed": F.lit(False)}
    return F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SEGMENT.fields])


def paragraph_segment() -> Column:
    """The marker that ends a paragraph, as a segment column."""
    row = segment(writer.PARAGRAPH)
    own = {k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for k, v in row.items()}
    return F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SEGMENT.fields])


def paragraphs(text: Column) -> Column:
    """Lines as text segments, each closed by a paragraph marker."""
    return F.flatten(F.transform(F.split(text, "\n"), lambda line: F.array(text_segment(line), paragraph_segment())))


def encoded(df: DataFrame, key: str, columns: list[str], build: Callable[..., bytes]) -> DataFrame:
    """(file_id, content): a container for each row, built by a Python function of its columns.

    Containers cost far more to build and to decode than rows cost to move, so rows are dealt evenly over all cores first.
    """
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.string()), pa.array([build(*row) for row in zip(*values)], pa.binary())], ["file_id", "content"])

    return df.select(key, *[c for c in columns if c != key]).repartition(tasks).mapInArrow(run, "file_id string, content binary")


def plain_container(text: str | None) -> bytes:
    """Two equal copies of the text's chunk, and a component's name."""
    body = writer.chunk(writer.paragraphs(text or ""))
    return writer.container(body, writer.package(KNOWN_COMPONENTS[0], "1"), body)


def framed_container(title: str, text: str | None) -> bytes:
    """A page whose framing names its title and its body, besides a table cell that is neither."""
    channels = {
        "T": (PACKAGE_TITLE, writer.chunk([title, writer.PARAGRAPH])),
        "E": (PACKAGE_BODY, writer.chunk(writer.paragraphs(text or ""), sequence=2)),
        "C": ("Table", writer.chunk(["a cell", writer.PARAGRAPH], sequence=3)),
    }
    return writer.container(writer.summary(channels, {"CanvasComponentHandle": "/E"}), writer.package(KNOWN_COMPONENTS[0], "1"))


def logged_container(turns: list[str | None]) -> bytes:
    """An empty page with a log that inserts each turn (null: empty) at the end, and then takes the first character away again, both halves of it if it has two."""
    log, at, texts = [], 0, [text or "" for text in turns]
    for text in texts:
        log.append(writer.delta("E", writer.insert(at, text)))
        at += len(text.encode("utf-16-le")) // 2
    if at:
        first = next(filter(None, texts))[0]
        log.append(writer.delta("E", writer.remove(0, len(first.encode("utf-16-le")) // 2)))
    page = writer.summary({"E": (PACKAGE_BODY, None)}, None, 7, 8, log)
    return writer.container(page, writer.package(KNOWN_COMPONENTS[1]), json.dumps({"segmentTexts": []}).encode())
