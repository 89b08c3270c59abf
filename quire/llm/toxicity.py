"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios (Wang and Manning, 2012).

The features of a text are the n-grams of its bytes (A-Z lower-cased) for each n of SIZES, hashed into 2**BITS places;
a feature counts once per text. Each is scaled by the logarithm of its smoothed share among toxic over that among other
training texts; a logistic regression on the scaled features gives the weights. Features without evidence (few texts,
or a chi-square below MIN_CHI2 or CHI2_SHARE of the labels) have weight 0, so that long texts don't gather noise.

Defined cases: a null text is as empty and gets the score of no features; with no labels of both kinds every score
is 0; a document with contradicting labels counts as toxic; labels without a document are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, bounded_sample, fold_of, give_back, powers, prefix_hash, small_batches, text_chunks, tidy

SIZES = (4, 5, 6)
BITS = 20
#: Labelled rows of each kind on which the classifier is fitted, by their whole texts.
SAMPLE_ROWS = 2500
#: Bytes of text whose features the fit holds at once.
TRAIN_BYTES = 1 << 18
MIN_TEXTS = 4
#: Least chi-square of a feature; with few labels, this share of their number (chi-square is at most that number).
MIN_CHI2, CHI2_SHARE = 30.0, 0.25
SMOOTHING = 1.0
PENALTY = 0.02
STEPS = 150
THRESHOLD = 0.5
_SPREAD = np.uint64(0x9FB21C651E98DF25)


@dataclass
class Classifier:
    weights: np.ndarray  # by place; most are 0
    bias: float

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of the texts that stand in buf."""
        n = len(offsets) - 1
        doc, place = hit_features(buf, offsets, self.weights != 0)
        z = self.bias + np.bincount(doc, weights=self.weights[place], minlength=n)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def features(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, place) of every n-gram of one size that lies within one text."""
    n = len(buf) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = prefix_hash(buf)
    h = (prefix[size:] - prefix[:-size]) * powers(len(prefix))[1][:n]
    place = (((h ^ (h >> np.uint64(32))) * _SPREAD + np.uint64(size)) * _SPREAD >> np.uint64(64 - BITS)).astype(np.int64)
    ok = np.ones(n, dtype=bool)
    for cut in offsets[1:-1]:
        ok[max(0, cut - size + 1) : min(n, cut)] = False
    at = np.flatnonzero(ok) if not ok.all() else np.arange(n)
    return at, place[at]


def hit_features(buf: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place) of the n-grams whose place is wanted."""
    buf = LOWER[buf]
    docs, places = [], []
    for size in SIZES:
        at, place = features(buf, offsets, size)
        hit = wanted[place]
        docs.append(np.searchsorted(offsets, at[hit], "right") - 1)
        places.append(place[hit])
    both = np.unique((np.concatenate(docs) << BITS) | np.concatenate(places))
    return both >> BITS, both & ((1 << BITS) - 1)


def train(texts: list[str] | pa.Array, toxic: list[int]) -> Classifier | None:
    """Fits the classifier; None unless both labels occur. Besides the texts it holds the features of TRAIN_BYTES of them at a time."""
    y = np.array(toxic, dtype=np.float64)
    if not len(y) or not 0 < y.sum() < len(y):
        return None
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    counts = np.zeros((2, 1 << BITS))
    everything = np.ones(1 << BITS, dtype=bool)

    def each(wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for first, _, buf, offsets in text_chunks(column, TRAIN_BYTES):
            doc, place = hit_features(buf, offsets, wanted)
            yield doc + first, place

    for doc, place in each(everything):
        for k in (0, 1):
            counts[k] += np.bincount(place[y[doc] == k], minlength=1 << BITS)
    n = np.array([len(y) - y.sum(), y.sum()])
    share = (counts + SMOOTHING) / (n[:, None] + 2 * SMOOTHING)
    ratio = np.log(share[1] / share[0])
    total = counts.sum(axis=0)
    expected = total * n[1] / n.sum()
    spread = expected * (n[0] / n.sum()) * (1 - np.minimum(total / n.sum(), 0.999))
    chi2 = (counts[1] - expected) ** 2 / np.maximum(spread, 1e-9)
    chosen = (total >= MIN_TEXTS) & (chi2 >= min(MIN_CHI2, CHI2_SHARE * n.sum()))
    parts = list(each(chosen))
    doc, place = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    columns = np.flatnonzero(chosen)
    if not len(columns):
        return Classifier(np.zeros(1 << BITS), float(np.log(n[1] / n[0])))
    col = np.searchsorted(columns, place)
    value = ratio[place]
    weight = 0.5 / n[y.astype(int)]  # both kinds count alike
    w, b = np.zeros(len(columns)), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(doc, weights=w[col] * value, minlength=len(y))
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.append(np.bincount(col, weights=e[doc] * value, minlength=len(w)) + PENALTY * w / len(w), e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    out = np.zeros(1 << BITS)
    out[columns] = w * ratio[columns]
    return Classifier(out, float(b))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Classifier | None:
    """A classifier fitted on at most sample_rows labelled rows of each kind whose id is not held out.

    The sample is drawn from the labels, so its ids (at most 2 * sample_rows) are broadcast and docs is read without a shuffle.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where((fold_of(F.col("id")) != 0) & F.col("label").isin(0, 1))
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    chosen = bounded_sample(marks, "label", sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    got = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text")).orderBy("id").select("label", "text").toArrow()
    toxic, column = got["label"].to_pylist(), got["text"].cast(pa.large_string()).combine_chunks()
    del got
    model = train(column, toxic)
    del column
    give_back()
    return model


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier | None = held.value
        for batch in batches:
            for first, end, buf, offsets in text_chunks(batch.column(1)):
                n = end - first
                score = model.scores(buf, offsets) if model else np.zeros(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(score, pa.float64())], ["id", "score"])

    return run


def scored(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score and predicted. One pass without a shuffle; the weights (2**BITS doubles) are broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    df = df.mapInArrow(tidy(_score(held)), f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return df.select(F.col("id").alias(id_col), F.coalesce(fold_of(F.col("id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: Classifier | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    spark = docs.sparkSession
    small_batches(spark)
    held, column = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Classifier | None = held.value
        for batch in batches:
            for first, end, buf, offsets in text_chunks(batch.column(column)):
                part = batch.slice(first, end - first)
                yield part.filter(pa.array(m.scores(buf, offsets) < threshold, pa.bool_())) if m else part

    return docs.mapInArrow(tidy(run), docs.schema)
