"""Shared pieces of the text operators: batch access, hashing, sampling and shared storage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch; a row that is longer stands alone.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes of text that the numpy kernels hold at once (they need some 40 times that in arrays).
CHUNK_BYTES = 1 << 19

#: Keys that may count as hot, the least rows of one that does, and the parts into which its rows are dealt.
HOT_KEYS, HOT_ROWS, SALTS = 1000, 1000, 32
#: Blocks in which the rows of a label are ranked for a sample.
SAMPLE_BLOCKS = 25

#: The separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of them at least. Those for usual chunks are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS
    out = []
    for base in (_BASE, _UNBASE):
        p = np.full(max(n, 2 * CHUNK_BYTES), base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    if n <= 2 * CHUNK_BYTES:
        _POWERS[:] = out
    return out


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash gives the hash of any span of buf."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): equal bytes give equal hashes wherever they stand."""
    return mix64((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words [^\\x20\\x09-\\x0D]+ of the texts that stand in buf."""
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = ~IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into (first row, end row, bytes, offsets) of about max_bytes; a longer text stands alone. Null is as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + max_bytes, "right")) - 1)
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def give_back() -> None:
    """Gives the memory that this process has freed back to the system."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel, after which its worker gives freed memory back: an idle worker would hold some 120 MB while the JVM works."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def small_batches(spark: SparkSession) -> None:
    """Keeps the batches that Python workers get within BATCH_ROWS rows and BATCH_BYTES bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.sparkContext.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='quire-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stored writes within this block are deleted at its end, but for those it is told to keep."""
    made: list[str] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """The rows of df, written to the shared folder and read again: cuts the lineage, and survives lost executors."""
    folder, made = shared_folder(df.sparkSession), _SCRATCH.get()
    if made is not None and not keep:
        made.append(folder)
    path = f"{folder}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, such that df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """The keys that hold more than 1 / HOT_KEYS of all rows, so HOT_KEYS at most: few enough to be broadcast, whatever the input. counts holds each key once, with its rows."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > max(HOT_ROWS, total // HOT_KEYS)).select(key)


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, by: str) -> DataFrame:
    """Inner join of big with small, which holds each key once; rows of hot keys are dealt over SALTS tasks by a hash of their column by."""
    marked = F.broadcast(hot.select(key, F.lit(SALTS).alias("_salts")))
    spread = big.join(marked, key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(by).cast("string")), F.lit(SALTS))).cast("int")).drop("_salts")
    times = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    return spread.join(small.join(marked, key, "left").withColumn("_salt", F.explode(times)).drop("_salts"), [key, "_salt"]).drop("_salt")


def bounded_sample(df: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most about per_label rows of every label, by a hash of the whole row: a bounded, repeatable sample for fitting a model.

    Labels are few (a model has an output for each). A pass over (label) counts the rows, so that the second pass ranks
    little more than what is asked for, in SAMPLE_BLOCKS blocks of hashes for each label.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if not counts:
        return df.limit(0)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(1.0 if n <= per_label else (1.3 * per_label + 100) / n)).otherwise(share)
    thin = df.withColumns({"_h": F.xxhash64(*df.columns), "_share": share}).where((F.col("_h").cast("double") / F.lit(2.0**64) + 0.5) <= F.col("_share"))
    block = Window.partitionBy(label, F.pmod("_h", F.lit(SAMPLE_BLOCKS))).orderBy("_h")
    ranked = thin.withColumn("_rank", F.row_number().over(block))
    return ranked.where((F.col("_share") >= 1) | (F.col("_rank") <= -(-per_label // SAMPLE_BLOCKS))).drop("_rank", "_h", "_share")
