"""Substring dedup by hashing lines and the clauses within them.

A text's words `[^\\x20\\x09-\\x0D]+` are cut into units: a unit ends where its line does, and after a word that ends in one
of MARKS, so that a passage is found wherever it stands in a line. A unit is normalised (A-Z lower-cased, one space between
words) and hashed to 128 bits. Over all documents, the earliest document that holds a digest, by id and then text, keeps
it; in every other one the unit is a repeat. Repeats that follow one another in a text form a run, and a run of MIN_WORDS
words or more is removed, so that passages go while common clauses and short lines, which every text holds, stay;
min_words=1 removes every repeat. A removed span reaches from the run's first word to the word after its last one, or to
the end of the text. Offsets are code points of the original text.

Defined cases: what a text repeats within itself stays, unless an earlier document has it; a null or wordless text has no
units and stays as it is (null stays null); rows of equal id and text are one document, judged once and returned as often
as they occur; null ids rank first; an empty table has no rows. A passage loses up to one clause at each end to the words
that it is joined to, so of a passage just over MIN_WORDS words in the middle of a sentence less may match, and it stays.

whole=True leaves no such rest, and asks that one earlier document holds the words together: a word goes if it stands in
min_words words in a row that an earlier document holds in a row, wherever units end. Windows of min_words words are hashed,
but only around digests of about half as many words that two documents share; of these a text gives the least one of each
window, so that two texts with a window in common have one of them in common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import HOT_KEYS, LOWER, SALTS, hot_keys, mix64, powers, prefix_hash, salted_join, small_batches, span_hash, stored, text_chunks, words_of

MIN_WORDS = 50
MARKS = ".,;:!?|"
#: Rows of the sample in which digests are looked for that many documents share. It decides where these are compared, not what is found.
SAMPLE_ROWS = 20_000
_IS_MARK = np.zeros(256, dtype=bool)
_IS_MARK[list(MARKS.encode())] = True
_LANES = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)), (np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)))
REMOVED = "array<struct<start:int,end:int,words:int>>"


@dataclass
class Units:
    """The units of the texts that stand in a buffer, in order."""

    doc: np.ndarray  # number of the text
    number: np.ndarray  # number within the text
    words: np.ndarray
    start: np.ndarray  # of its first word, in bytes
    end: np.ndarray  # of its last word
    first: np.ndarray  # number of its first word in the buffer


def units_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[Units, np.ndarray, np.ndarray]:
    """The units, and the starts and ends of all words."""
    starts, ends, doc = words_of(buf, offsets)
    lines = np.cumsum(buf == 10)
    last = np.ones(len(starts), dtype=bool)
    if len(starts):
        last[:-1] = _IS_MARK[buf[ends[:-1] - 1]] | (lines[ends[:-1] - 1] != lines[starts[1:]]) | (doc[:-1] != doc[1:])
    end = np.flatnonzero(last)
    first = np.append(0, end[:-1] + 1)[: len(end)]
    number = np.arange(len(end))
    if len(end):
        number -= np.searchsorted(doc[first], doc[first])
    return Units(doc[first], number, end - first + 1, starts[first], ends[end], first), starts, ends


def digests(buf: np.ndarray, units: Units, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each unit's words in order."""
    if not len(units.doc):
        return [np.zeros(0, dtype=np.int64)] * 2
    h = span_hash(prefix_hash(LOWER[buf]), starts, ends)
    place = (np.arange(len(h)) - np.repeat(units.first, units.words)).astype(np.uint64)
    return [mix64(np.add.reduceat(mix64((h ^ salt) + (place + np.uint64(1)) * step), units.first)).view(np.int64) for step, salt in _LANES]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, print, text) -> (id, print, unit, hi, lo); unit holds the unit's number above, its words below."""
    for batch in batches:
        for row, _, buf, offsets in text_chunks(batch.column(2)):
            units, starts, ends = units_of(buf, offsets)
            keys = [batch.column(c).take(pa.array(units.doc + row)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array((units.number << 32) | units.words), *map(pa.array, digests(buf, units, starts, ends))], ["id", "print", "unit", "hi", "lo"])


def grams(h: np.ndarray, n: int, lanes: int = 2) -> list[np.ndarray]:
    """64-bit hashes of the n words from each word on, given the words' hashes; one for each lane."""
    first = np.arange(max(0, len(h) - n + 1))
    power = powers(len(h) + 1)[0][: len(h)]
    return [span_hash(np.append(np.uint64(0), np.cumsum(mix64(h ^ salt) * power, dtype=np.uint64)), first, first + n) for salt, _ in _LANES[:lanes]]


def least_in_windows(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value among the width values from each place on."""
    best, size = np.arange(len(g)), 1

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[b] < g[a], b, a)

    while 2 * size <= width:
        best, size = lesser(best[: len(best) - size], best[size:]), 2 * size
    return lesser(best[: len(best) - (width - size)], best[width - size :])


def _words(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts that stand in a buffer: each word's hash, text and number within it, and the words from which on n words are of one text."""
    starts, ends, doc = words_of(buf, offsets)
    last = max(0, len(doc) - n + 1)
    return span_hash(prefix_hash(LOWER[buf]), starts, ends), doc, np.arange(len(doc)) - np.searchsorted(doc, doc), np.flatnonzero(doc[:last] == doc[len(doc) - last :])


def _anchors(min_words: int):
    """(id, print, text) -> (id, print, at, hi): of every window the least digest of half as many words, once for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = -(-min_words // 2)
        for batch in batches:
            for row, _, buf, offsets in text_chunks(batch.column(2)):
                h, doc, number, windows = _words(buf, offsets, min_words)
                if len(windows):
                    g = grams(h, half, 1)[0]
                    at = np.unique(least_in_windows(g, min_words - half + 1)[windows])
                    keys = [batch.column(c).take(pa.array(doc[at] + row)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(number[at].astype(np.int32)), pa.array(g[at].view(np.int64))], ["id", "print", "at", "hi"])

    return run


def _windows(min_words: int):
    """(id, print, text, places) -> (id, print, unit, hi, lo) of the windows that hold the digests at these places; unit has the number of the first word above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = min_words - -(-min_words // 2)
        for batch in batches:
            places = batch.column(3)
            for row, end, buf, offsets in text_chunks(batch.column(2)):
                h, doc, number, windows = _words(buf, offsets, min_words)
                near = np.zeros(len(h) + 1, dtype=np.int64)
                begin = np.searchsorted(doc, np.arange(end - row))
                for k in range(row, end):
                    at = places[k].values.to_numpy(zero_copy_only=False) + begin[k - row]
                    np.add.at(near, np.maximum(at - reach, begin[k - row]), 1)
                    np.add.at(near, at + 1, -1)
                first = windows[np.cumsum(near)[windows] > 0]
                keys = [batch.column(c).take(pa.array(doc[first] + row)) for c in (0, 1)]
                found = [pa.array(g[first].view(np.int64)) for g in grams(h, min_words)] if len(first) else [pa.array([], pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([*keys, pa.array((number[first] << 32) | min_words), *found], ["id", "print", "unit", "hi", "lo"])

    return run


def long_runs(repeated: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """[first, end) of the runs of repeated units that have min_words words or more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    total = np.append(0, np.cumsum(words))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if total[b] - total[a] >= min_words]


def without(text: bytes, spans: list[tuple[int, int, int]]) -> tuple[list[dict], str]:
    """The spans (start, end, words; in bytes) in code points, and the text that stays."""
    points = np.append(0, np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))
    gone, kept, at = [], [], 0
    for start, end, words in spans:
        gone.append({"start": int(points[start]), "end": int(points[end]), "words": words})
        kept.append(text[at:start])
        at = end
    return gone, b"".join([*kept, text[at:]]).decode()


def cut(text: bytes, numbers: list[int], min_words: int) -> tuple[list[dict], str]:
    """The spans that go, in code points, and the text that stays; numbers are those of the repeated units."""
    buf = np.frombuffer(text, dtype=np.uint8)
    units, _, _ = units_of(buf, np.array([0, len(buf)]))
    repeated = np.zeros(len(units.doc), dtype=bool)
    repeated[numbers] = True
    starts = np.append(units.start, len(buf))
    return without(text, [(int(starts[a]), int(starts[b]), int(units.words[a:b].sum())) for a, b in long_runs(repeated, units.words, min_words)])


def cut_windows(text: bytes, first: list[int], min_words: int) -> tuple[list[dict], str]:
    """As cut; first are the numbers of the first words of repeated windows of min_words words."""
    buf = np.frombuffer(text, dtype=np.uint8)
    starts = np.append(words_of(buf, np.array([0, len(buf)]))[0], len(buf))
    change = np.zeros(len(starts), dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, np.array(first) + min_words, -1)
    words = np.ones(len(starts) - 1, dtype=np.int64)
    return without(text, [(int(starts[a]), int(starts[b]), b - a) for a, b in long_runs(np.cumsum(change)[:-1] > 0, words, 1)])


def _cut(min_words: int, cut: Callable[[bytes, list[int], int], tuple[list[dict], str]]):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [([], t) if not n else cut(t.encode(), n, min_words) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], ["id", "removed", "kept_text"])

    return run


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("print"), text.alias("text"))


def _later(units: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc, unit) of the rows (id, print, unit, hi, lo) whose digest an earlier document holds.

    Digests that hold more than 1 / HOT_KEYS of the rows of sample are dealt over SALTS tasks; the earliest document of each
    task meets those of the others in a table of at most HOT_KEYS rows.
    """
    counts = stored(sample.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(100, total // HOT_KEYS)).select("hi", "lo", F.lit(True).alias("hot"))
    units = units.join(F.broadcast(hot), ["hi", "lo"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    units = units.withColumn("salt", F.when(F.col("hot"), F.pmod(F.col("print"), F.lit(SALTS))).otherwise(0).cast("int"))
    doc, first = F.struct(F.col("id").isNotNull().alias("known"), "id", "print"), F.col("first")
    order = Window.partitionBy("hi", "lo", "salt").orderBy(F.col("id").asc_nulls_first(), "print").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = stored(units.withColumn("doc", doc).withColumn("first", F.first("doc").over(order)).where(F.col("hot") | (first != F.col("doc"))).select("hi", "lo", "hot", "doc", "unit", "first"))
    leads = seen.where("hot").groupBy("hi", "lo").agg(F.min("first").alias("lead"))
    return seen.join(F.broadcast(leads), ["hi", "lo"], "left").where(F.coalesce("lead", "first") != F.col("doc")).select("doc", "unit")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, print, units) of the documents with min_words words or more in units that an earlier document holds; units are their numbers.

    Texts are parsed once, and narrow rows are shuffled by digest.
    """
    kind, n = docs.schema[id_col].dataType.simpleString(), docs.count()
    parsed = lambda df: df.mapInArrow(_emit, f"id {kind}, print long, unit long, hi long, lo long")
    base = _base(docs, id_col, text_col).where(F.col("text").isNotNull())
    later = _later(parsed(base), parsed(base.sample(min(1.0, SAMPLE_ROWS / max(1, n)), seed=7).select("id", "print", "text")))
    words = F.sum(F.col("unit").bitwiseAND(F.lit((1 << 32) - 1)))
    found = later.select("doc.id", "doc.print", "unit").groupBy("id", "print").agg(F.collect_set(F.shiftright("unit", 32).cast("int")).alias("units"), words.alias("words"))
    return found.where(F.col("words") >= min_words).select("id", "print", "units")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, print, units) of the documents with min_words words in a row that an earlier document holds in a row; units are the numbers of the first words of all such windows.

    Texts are parsed twice: for the digests of half a window, and, where two documents share one, for the windows around it.
    """
    kind, n = docs.schema[id_col].dataType.simpleString(), docs.count()
    base = _base(docs, id_col, text_col).where(F.col("text").isNotNull())
    anchors = stored(base.mapInArrow(_anchors(min_words), f"id {kind}, print long, at int, hi long").withColumn("doc", F.xxhash64("id", "print")))
    shared = stored(anchors.groupBy("hi").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).where("a != b"))
    near = salted_join(anchors, shared.select("hi"), "hi", hot_keys(shared, "hi", "n"), "doc")
    places = near.groupBy(F.col("id").alias("_id"), F.col("print").alias("_print")).agg(F.collect_set("at").alias("places"))
    joined = base.join(places, base["id"].eqNullSafe(F.col("_id")) & (base["print"] == F.col("_print"))).select("id", "print", "text", "places")
    windows = stored(joined.mapInArrow(_windows(min_words), f"id {kind}, print long, unit long, hi long, lo long"))
    later = _later(windows, windows.sample(min(1.0, SAMPLE_ROWS / max(1, n)), seed=7))
    return later.select("doc.id", "doc.print", "unit").groupBy("id", "print").agg(F.collect_set(F.shiftright("unit", 32).cast("int")).alias("units"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """Per document row: id, removed (spans in the original text) and kept_text. Texts are shuffled once, by document; twice where whole passages are looked for."""
    small_batches(docs.sparkSession)
    repeated = repeated_windows if whole else repeated_units
    found = repeated(docs, id_col, text_col, min_words).select(F.col("id").alias("_id"), F.col("print").alias("_print"), "units")
    base = _base(docs, id_col, text_col)
    joined = base.join(found, base["id"].eqNullSafe(F.col("_id")) & (base["print"] == F.col("_print")), "left").select("id", "text", "units")
    kernel = _cut(min_words, cut_windows if whole else cut)
    return joined.mapInArrow(kernel, f"id {docs.schema[id_col].dataType.simpleString()}, removed {REMOVED}, kept_text string").withColumnRenamed("id", id_col)
