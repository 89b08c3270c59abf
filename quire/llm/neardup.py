"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a shingle is five consecutive words, and a text of one
to four words is one shingle. A shingle weighs as often as it occurs in its text. Every shingle emits a Poisson process
of arrivals, at the rate of its weight, over the registers of the signature; a register keeps the shingle that arrived
first, so two registers agree with the probability Jaccard similarity of the two texts (Moulton and Jiang, 2018). A
shingle stops emitting once its next arrival is later than every register. Links are pairs of texts whose probability
Jaccard similarity, computed from the weights, is THRESHOLD or more; where no shingle repeats it is the Jaccard similarity.

Defined cases: texts that are equal are one node whatever their number; a null text is alone in its class and so is
a text without words unless an equal text exists; a null id keeps its row; a class is named by its least id, and its
kept row is the one of least id and, at equal ids, of least MD5; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import LOWER, free_name, hot_keys, mix64, prefix_hash, salted_join, scratch, small_batches, span_hash, stored, text_chunks, tidy, words_of

WORDS = 5
THRESHOLD = 0.8
#: 28 bands of 6 registers: a pair at 0.8 shares a band with probability 0.9998, one at 0.3 with 0.02.
BANDS, ROWS = 28, 6
#: Rounds in which open buckets get one pivot more, before all pairs that are left are compared.
ROUNDS = 2
#: Rows of a batch of single shingles.
TOKENS = 1 << 19
_STEP = np.uint64(0xD6E8FEB86659FD93)
_TURN = np.uint64(0x9E3779B97F4A7C15)


def shingles_of(buf: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of all shingles, in order of the texts; repeated ones stay."""
    buf = LOWER[buf]
    starts, ends, doc = words_of(buf, offsets)
    if not len(starts):
        return doc, np.zeros(0, dtype=np.uint64)
    h = span_hash(prefix_hash(buf), starts, ends)
    n = len(h)
    per_doc = np.bincount(doc, minlength=len(offsets) - 1)
    out_doc, out = [], []
    if n >= k:
        s = h[: n - k + 1].copy()
        for j in range(1, k):
            s = mix64(s * _STEP + h[j : n - k + 1 + j])
        whole = doc[: n - k + 1] == doc[k - 1 :]
        out_doc.append(doc[: n - k + 1][whole])
        out.append(s[whole])
    first = np.cumsum(per_doc) - per_doc
    for d in np.flatnonzero((per_doc > 0) & (per_doc < k)):
        s = h[first[d] : first[d] + 1]
        for j in range(1, per_doc[d]):
            s = mix64(s * _STEP + h[first[d] + j : first[d] + j + 1])
        out_doc.append(np.array([d]))
        out.append(s ^ np.uint64(per_doc[d]))
    docs, hashes = np.concatenate(out_doc), np.concatenate(out)
    order = np.argsort(docs, kind="stable")
    return docs[order], hashes[order]


def distinct_weights(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their counts, ordered by text and hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Signatures (n_docs x registers) of texts with weighted elements; texts without elements get zeros."""
    arrival = np.full(n_docs * registers, np.inf)
    holder = np.zeros(n_docs * registers, dtype=np.uint64)
    latest = np.full(n_docs, np.inf)
    alone = np.bincount(doc, minlength=n_docs) == 1
    if alone.any():
        single = alone[doc]
        holder.reshape(n_docs, registers)[doc[single]] = h[single][:, None]
        doc, h, weight = doc[~single], h[~single], weight[~single]
    state, rate, time = h.copy(), 1.0 / weight, np.zeros(len(h))
    while len(doc):
        state = state + _TURN
        draw = mix64(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        on = time < latest[doc]
        if not on.all():
            doc, h, rate, time, state, draw = (x[on] for x in (doc, h, rate, time, state, draw))
            if not len(doc):
                break
        cell = doc * registers + (mix64(draw ^ _STEP) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(arrival, cell, time)
        won = arrival[cell] == time
        holder[cell[won]] = h[won]
        touched = np.unique(doc)
        latest[touched] = arrival.reshape(n_docs, registers)[touched].max(axis=1)
    return holder.reshape(n_docs, registers)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signatures), bands), dtype=np.uint64) + mix64(np.arange(1, bands + 1, dtype=np.uint64))
    parts = signatures.reshape(len(signatures), bands, rows)
    for j in range(rows):
        out = mix64(out * _STEP + parts[:, :, j])
    return out.view(np.int64)


def signature_kernel(bands: int, rows: int, k: int):
    """(node, row, text) -> (node, row, bands); a text without words has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, offsets in text_chunks(batch.column(2)):
                n = end - first
                doc, h, weight = distinct_weights(*shingles_of(buf, offsets, k))
                got = band_hashes(prob_minhash(doc, h, weight.astype(np.float64), n, bands * rows), bands, rows)
                some = np.flatnonzero(np.bincount(doc, minlength=n))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bands, pa.int32()), pa.array(got[some].ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, n).take(pa.array(some)) for c in (0, 1)), lists], ["node", "row", "bands"])

    return run


def shingle_kernel(k: int):
    """(node, text) -> (node, shingles, counts): the sorted distinct shingle hashes as bytes, and their counts where one is above 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, offsets in text_chunks(batch.column(1)):
                n = end - first
                doc, h, weight = distinct_weights(*shingles_of(buf, offsets, k))
                at, weight = np.searchsorted(doc, np.arange(n + 1)), weight.astype(np.uint32)
                spans = list(zip(at[:-1], at[1:]))
                data, counts = [h[a:b].tobytes() for a, b in spans], [weight[a:b].tobytes() if (weight[a:b] > 1).any() else b"" for a, b in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(data, pa.binary()), pa.array(counts, pa.binary())], ["node", "shingles", "counts"])

    return run


def weighted_set(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(shingles, np.uint64)
    return h, np.frombuffer(counts, np.uint32).astype(np.float64) if counts else np.ones(len(h))


def token_kernel(batch_tokens: int = TOKENS):
    """(node, shingles, counts) -> (node, shingle, mass): a row for each of a node's shingles, with its share of the node's weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, counts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            n = np.array([len(x) // 8 for x in data], dtype=np.int64)
            ends, row = np.cumsum(n), 0
            while row < len(n):
                end = max(row + 1, int(np.searchsorted(ends, ends[row] - n[row] + batch_tokens, "right")))
                at = np.repeat(np.arange(row, end), n[row:end])
                h = np.frombuffer(b"".join(data[row:end]), dtype=np.int64)
                mass = [w / w.sum() for w in (weighted_set(x, c)[1] for x, c in zip(data[row:end], counts[row:end]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(h), pa.array(np.concatenate(mass))], ["node", "shingle", "mass"])
                row = end

    return run


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i)."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    u, v = x[1][i], y[1][j]
    order = np.argsort(u / v, kind="stable")  # those after i have x_j / x_i as the larger quotient, those before it y_j / y_i
    u, v = u[order], v[order]
    above, below = np.cumsum(u[::-1])[::-1], np.cumsum(v) - v
    return float((1 / ((x[1].sum() - u.sum() + above) / u + (y[1].sum() - v.sum() + below) / v)).sum())


def verify_kernel(threshold: float):
    """(a, b, weighted sets of a and of b) -> the pairs whose probability Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [probability_jaccard(weighted_set(x, n), weighted_set(y, m)) >= threshold - 1e-9 for x, n, y, m in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the undirected edges (a, b); comp is the least node of its component.

    Each round takes the least label among the neighbours and then follows labels to their own labels, so the number
    of rounds grows with the logarithm of the longest path. Every round is written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = stored(lower.join(jump, "comp", "left").select("node", "was", F.least("comp", "next").alias("comp")))
        labels = step.select("node", "comp")
        if step.where(F.col("was") != F.col("comp")).isEmpty():
            return labels


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, comp) with the components joined that the links connect; a node that comp lacks is a component of its own."""
    edges = named(links, comp).select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a != b").distinct()
    roots = stored(components(edges).withColumnsRenamed({"node": "label", "comp": "root"}))
    old = comp.join(roots, F.col("comp") == F.col("label"), "left").select("node", F.coalesce("root", "comp").alias("comp"))
    new = roots.join(comp, F.col("label") == F.col("node"), "left_anti").select(F.col("label").alias("node"), F.col("root").alias("comp"))
    return stored(old.union(new))


def named(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """pairs (a, b) with the components ca and cb of their nodes."""
    out = pairs.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left")
    out = out.join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    return out.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of nodes with different comp; of those whose probability Jaccard similarity reaches the threshold, all. sets holds (node, comp, shingles, counts).

    A prefix filter: the similarity is at most the common mass of the two (the sum of the lesser shares), and with the
    shingles of every node in one order, rarest first, that is at most what either node has from the first common
    shingle on. So nodes at the threshold t meet on a shingle before which neither has more than 1 - t of its mass. Between
    nodes without repeated shingles the similarity is the Jaccard similarity, which asks for more: of n and m shingles,
    t / (1 + t) (n + m) are common, and as many must follow in both. Shingles of one component meet nothing. Of each shingle's
    nodes, those outside its largest component are joined with all, so that a component never meets itself.
    """
    about = sets.select("node", "comp", (F.octet_length("shingles") / 8).cast("long").alias("n"), (F.octet_length("counts") == 0).alias("flat"))
    tokens = stored(sets.select("node", "shingles", "counts").mapInArrow(tidy(token_kernel()), "node binary, shingle long, mass double").join(about, "node"))
    per = tokens.groupBy("shingle", "comp").agg(F.count("*").alias("k"))
    common = per.groupBy("shingle").agg(F.sum("k").alias("df"), F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("top")).where("comps > 1")
    common = stored(common.select("shingle", "df", F.col("top.comp").alias("top")))
    order = Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(0)), "shingle")
    before = F.coalesce(F.sum("mass").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    front = tokens.join(common, "shingle", "left").withColumns({"before": before, "rest": F.col("n") - F.row_number().over(order) + 1})
    front = stored(front.where(F.col("df").isNotNull() & (F.col("before") <= 1 - threshold + 1e-9)).select("shingle", "node", "comp", "n", "flat", "rest", "top"))
    other = front.select("shingle", *(F.col(c).alias(f"{c}_y") for c in ("node", "comp", "n", "flat", "rest")))
    enough = F.least("rest", "rest_y") >= threshold / (1 + threshold) * (F.col("n") + F.col("n_y")) - 1e-6
    both = front.where("comp != top").join(other, "shingle").where((F.col("comp") != F.col("comp_y")) & (~F.col("flat") | ~F.col("flat_y") | enough))
    return both.select(F.least("node", "node_y").alias("a"), F.greatest("node", "node_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, k: int = WORDS) -> DataFrame:
    """One row per document: id, class_id (least id of its class), class_size, n_links (verified links of its text to other texts), keep (its id and text are those that the class keeps) and text_md5.

    Equal texts are one node. Nodes that share a band meet in a bucket; within a bucket each is compared with one pivot,
    the node that shares most buckets with others, so a bucket of n costs n comparisons and never n * n. Pairs whose nodes
    are in one class by then are not compared. A bucket is open while its members beside the pivots are of several
    classes. Open buckets, and only these, get another pivot in each of ROUNDS rounds, and all pairs of different classes
    among the nodes that are in open buckets even then come from prefix_pairs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with scratch(spark):
        texts = base.where(F.col("text").isNotNull()).select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), F.xxhash64(F.col("id").cast("string")).alias("row"), "text")
        signed = texts.mapInArrow(tidy(signature_kernel(bands, rows, k)), "node binary, row long, bands array<bigint>")
        signed = stored(signed.groupBy("node").agg(F.first("bands").alias("bands"), F.min("row").alias("row")))
        in_band = signed.select(F.explode("bands").alias("key"), "node")
        shared = in_band.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        met = stored(in_band.join(shared, "key"))
        score = met.groupBy("node").agg(F.sum("n").alias("score"))
        met = stored(met.join(score, "node").select("key", "node", "score"))
        pivot = stored(met.groupBy("key").agg(F.max(F.struct("score", "node")).alias("top")).select("key", F.col("top.node").alias("pivot")))
        members = stored(met.join(pivot, "key").where("node != pivot"))
        pairs = stored(members.groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("times")))
        # Of equal texts one row is read again: the key holds the row, so that copies do not meet in one task.
        wanted = signed.select("node", "row").join(met.select("node").distinct(), "node", "left_semi")
        sets = texts.join(wanted, ["node", "row"], "left_semi").select("node", "text").mapInArrow(tidy(shingle_kernel(k)), "node binary, shingles binary, counts binary")
        sets = stored(sets.groupBy("node").agg(F.first(F.struct("shingles", "counts")).alias("s")).select("node", "s.*"))

        def verified(candidates: DataFrame) -> DataFrame:
            x = candidates.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"), F.col("counts").alias("n")), "a")
            hot = hot_keys(candidates.groupBy("b").agg(F.count("*").alias("n")), "b", "n")
            x = salted_join(x, sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"), F.col("counts").alias("m")), "b", hot, "a").select("a", "b", "x", "n", "y", "m")
            return stored(x.mapInArrow(tidy(verify_kernel(threshold)), "a binary, b binary"))

        best = stored(pairs.groupBy("a").agg(F.max(F.struct("times", "b")).alias("top")).select("a", F.col("top.b").alias("b")))
        links = verified(best)
        comp = components(links)
        more = verified(stored(named(pairs.join(best, ["a", "b"], "left_anti").select("a", "b"), comp).where("ca != cb").select("a", "b")))
        left = members.select("key", "node", "score")
        for step in range(ROUNDS + 1):
            if not more.isEmpty():
                links, comp = stored(links.union(more)), merged(comp, more)
            left = left.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            still = left.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.max(F.struct("score", "node", "comp")).alias("top")).where("least != most")
            left = stored(left.join(still.select("key", F.col("top.node").alias("pivot"), F.col("top.comp").alias("class")), "key"))
            if step == ROUNDS or left.isEmpty():
                break
            more = verified(stored(left.where("comp != class").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()))
            left = left.where("node != pivot").select("key", "node", "score")
        if not left.isEmpty():
            more = verified(stored(prefix_pairs(stored(left.select("node", "comp").distinct().join(sets, "node")), threshold)))
            if not more.isEmpty():
                links, comp = stored(links.union(more)), merged(comp, more)
        degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
        rows_ = base.where(F.col("text").isNotNull()).select("id", F.md5(F.col("text").cast("binary")).alias("text_md5")).withColumn("node", F.unhex("text_md5"))
        first = F.struct(F.col("id").isNull().alias("none"), "id", "node")
        nodes = rows_.groupBy("node").agg(F.min(first).alias("first"), F.count("*").alias("copies")).join(comp.join(degree, "node", "left"), "node", "left")
        nodes = stored(nodes.select("node", "first", "copies", F.coalesce("comp", "node").alias("comp"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
        classes = nodes.groupBy("comp").agg(F.min("first").alias("kept"), F.sum("copies").alias("class_size"))
        small = stored(nodes.join(classes, "comp").select("node", "copies", "kept", "class_size", "n_links"), keep=True)
    out = salted_join(rows_, small.drop("copies"), "node", hot_keys(small, "node", "copies"), "id")
    keep = (F.col("node") == F.col("kept.node")) & F.col("id").eqNullSafe(F.col("kept.id"))
    out = out.select(F.col("id").alias(id_col), F.col("kept.id").alias("class_id"), "class_size", "n_links", keep.alias("keep"), "text_md5")
    alone = base.where(F.col("text").isNull()).select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(True), F.lit(None).cast("string"))
    return out.union(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that their classes keep: one for each class; of equal rows, one.

    Texts are shuffled once, by row and digest, so that equal texts of different ids do not meet in one task.
    """
    row, md5 = F.xxhash64(F.col(id_col).cast("string")), F.md5(F.col(text_col).cast("string").cast("binary"))
    key = [free_name(docs, "row"), free_name(docs, "md5")]
    kept = near_duplicates(docs, id_col, text_col).where("keep AND text_md5 IS NOT NULL").select(row.alias(key[0]), F.col("text_md5").alias(key[1])).distinct()
    texts = docs.where(F.col(text_col).isNotNull()).withColumns(dict(zip(key, (row, md5))))
    return texts.join(kept, key, "left_semi").dropDuplicates(key).drop(*key).union(docs.where(F.col(text_col).isNull()))
