"""Containers as a stream: files are decoded and rendered as they arrive, with the operators of the batch path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.model import Limits
from quire.plans.analysis import Analysis
from quire.sources.containers import files_of

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """(file_id, extension, file_size, content) of files as they appear; max_files bounds a trigger."""
    return files_of(spark.readStream.format("binaryFile").schema(_SCHEMA).option("maxFilesPerTrigger", max_files).load(path))


def render_stream(files: DataFrame, output: str, checkpoint: str, form: str = "markdown", limits: Limits = Limits(), trigger: dict | None = None) -> StreamingQuery:
    """Writes (file_id, rendered) of each batch of files into output. Each file is whole in one batch, so batch and stream agree.

    A batch is written to a folder of its own number, replaced if the batch runs again: nothing is lost or doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        a = Analysis(batch, limits)
        try:
            a.rendered(form).write.mode("overwrite").parquet(f"{output}/batch={number}")
        finally:
            a.release()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
