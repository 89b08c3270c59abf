"""Language identification by a convolutional network over bytes.

A text is cut into windows of WINDOW bytes (A-Z lower-cased, the last one filled with zeros). Each byte has a learned
vector; filters of several widths slide over the window, their largest response each is pooled, and a softmax layer
gives the languages' probabilities. A text's probabilities are the means over all its windows, weighted by their bytes.
The network is trained with numpy on a bounded sample of labelled rows. When it is applied, the filters are held as
tables by pairs of bytes, so that a filter of width 4 is the sum of two rows.

Defined cases: a text that is null or has no letter is `und` with score 0; if nothing is labelled, everything is `und`;
ties go to the language that sorts first; rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, bounded_sample, fold_of, small_batches, text_chunks

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
VECTOR = 8
#: Rows of each language on which the network is trained, by windows from anywhere in their texts.
SAMPLE_ROWS = 1500
STEPS, BATCH, RATE = 900, 64, 4e-3
UNKNOWN = "und"


@dataclass
class Network:
    labels: list[str]
    tables: list[tuple[np.ndarray, np.ndarray | None]]
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray
    vectors: np.ndarray  # of the bytes; with the filters, what the tables are made of
    filters: list[np.ndarray]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of windows (n x WINDOW, bytes)."""
        out = np.empty((len(windows), len(self.labels)), dtype=np.float32)
        for at in range(0, len(windows), 256):
            w = windows[at : at + 256].astype(np.int32)
            pairs = w[:, :-1] * 256 + w[:, 1:]
            pooled = []
            for width, (first, second), bias in zip(WIDTHS, self.tables, self.bias):
                n = w.shape[1] - width + 1
                x = first.take(pairs[:, :n], axis=0)
                if width == 3:
                    x += second.take(w[:, 2:], axis=0)
                elif width == 4:
                    x += second.take(pairs[:, 2 : 2 + n], axis=0)
                pooled.append(np.maximum(x.max(axis=1) + bias, 0))
            z = np.concatenate(pooled, axis=1) @ self.dense + self.dense_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + 256] = z / z.sum(axis=1, keepdims=True)
        return out


def windows_of(buf: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, the text number of each and its bytes that are not fill. An empty text has none."""
    count = -(-np.diff(offsets) // width)
    doc = np.repeat(np.arange(len(count)), count)
    start = offsets[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * width
    own = np.minimum(width, offsets[doc + 1] - start)
    return gathered(np.concatenate([LOWER[buf], np.zeros(width, dtype=np.uint8)]), start, own, width), doc, own


def gathered(padded: np.ndarray, start: np.ndarray, own: np.ndarray, width: int) -> np.ndarray:
    """The windows that begin at start, filled with zeros from own on; padded reaches a window's width beyond the texts."""
    out = padded[start[:, None] + np.arange(width)]
    out[np.arange(width)[None, :] >= own[:, None]] = 0
    return out


def train(texts: list[str], labels: list[str], seed: int = 5) -> Network:
    """Fits the network by Adam on windows of the texts; each step draws languages evenly, then texts, then their windows."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    padded = np.concatenate([LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)], np.zeros(WINDOW, dtype=np.uint8)])
    y, count = np.array([names.index(v) for v in labels]), -(-np.diff(offsets) // WINDOW)
    by_label = [np.flatnonzero((y == k) & (count > 0)) for k in range(len(names))]
    by_label = [v for v in by_label if len(v)]
    p = {"E": rng.normal(0, 0.3, (256, VECTOR))}
    p["E"][0] = 0
    for w in WIDTHS:
        p[f"W{w}"] = rng.normal(0, 1 / np.sqrt(w * VECTOR), (w * VECTOR, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p["D"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names)))
    p["c"] = np.zeros(len(names))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, STEPS + 1 if by_label else 1):
        pick = np.array([by_label[k][rng.integers(len(by_label[k]))] for k in rng.integers(len(by_label), size=BATCH)])
        start = offsets[pick] + rng.integers(count[pick]) * WINDOW
        xb, yb = gathered(padded, start, np.minimum(WINDOW, offsets[pick + 1] - start), WINDOW), y[pick]
        e = p["E"][xb]
        pooled, where = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            view = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
            r = view @ p[f"W{w}"] + p[f"b{w}"]
            where.append(r.argmax(axis=1))
            pooled.append(r.max(axis=1))
        f = np.concatenate(pooled, axis=1)
        a = np.maximum(f, 0)
        z = a @ p["D"] + p["c"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(BATCH), yb] -= 1
        q /= BATCH
        g = {"D": a.T @ q + 1e-4 * p["D"], "c": q.sum(axis=0), "E": np.zeros_like(p["E"])}
        back = (q @ p["D"].T) * (f > 0)
        for k, w in enumerate(WIDTHS):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            spots = where[k][:, :, None] + np.arange(w)
            codes = xb[np.arange(BATCH)[:, None, None], spots]
            view = p["E"][codes].reshape(BATCH, FILTERS, w * VECTOR)
            g[f"W{w}"] = np.einsum("bf,bfv->vf", d, view)
            g[f"b{w}"] = d.sum(axis=0)
            np.add.at(g["E"], codes, (d[:, :, None] * p[f"W{w}"].T[None]).reshape(BATCH, FILTERS, w, VECTOR))
        g["E"][0] = 0
        rate = RATE * (1 - 0.9 * step / STEPS)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    one = {w: [p["E"] @ p[f"W{w}"][j * VECTOR : (j + 1) * VECTOR] for j in range(w)] for w in WIDTHS}
    pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS).astype(np.float32)
    tables = [(pair(one[2][0], one[2][1]), None), (pair(one[3][0], one[3][1]), one[3][2].astype(np.float32)), (pair(one[4][0], one[4][1]), pair(one[4][2], one[4][3]))]
    return Network(names, tables, [p[f"b{w}"] for w in WIDTHS], p["D"], p["c"], p["E"], [p[f"W{w}"] for w in WIDTHS])


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """A network trained on at most sample_rows rows of each language whose id is not held out (fold_of is not 0); null languages don't count."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("label"))
    rows = rows.where((fold_of(F.col("id")) != 0) & F.col("label").isNotNull())
    got = bounded_sample(rows.select("id", "label", "text"), "label", sample_rows).where(F.col("text").rlike(r"\p{L}")).orderBy("label", "id", "text").toPandas()
    return train(got["text"].tolist(), got["label"].tolist()) if len(got) else None


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _identify(network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = network.value
        for batch in batches:
            for first, end, buf, offsets in text_chunks(batch.column(1)):
                n = end - first
                texts = batch.column(1).slice(first, n)
                lang, score = [UNKNOWN] * n, np.zeros(n)
                if net is not None:
                    windows, doc, own = windows_of(buf, offsets)
                    total = np.zeros((n, len(net.labels)))
                    np.add.at(total, doc, net.probabilities(windows) * own[:, None])
                    mean = total / np.maximum(np.diff(offsets), 1)[:, None]
                    best = mean.argmax(axis=1)
                    for i, text in enumerate(texts.to_pylist()):
                        if has_letter(text):
                            lang[i], score[i] = net.labels[best[i]], min(1.0, mean[i, best[i]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return run


def identified(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, lang_pred and score. One pass without a shuffle; the network (some 13 MB) is broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(network)
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    df = df.mapInArrow(_identify(held), f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
    return df.select(F.col("id").alias(id_col), F.coalesce(fold_of(F.col("id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accuracy(predicted: pd.Series, truth: pd.Series) -> float:
    return float((predicted == truth).mean())
