"""Byte-level BPE encoding and decoding by a file of ranks.

A text is cut by a pattern into pieces; each piece is merged on its own: again and again, the neighbouring pair of
least rank (the leftmost of equal ones) becomes one part. A segment tree over the byte positions holds the rank of the
pair that starts at each live position, so its root is the next merge, and a merge updates the positions of the part
and of its live neighbours in logarithmic time. A piece of n bytes costs O(n log n), however long it is.

Defined cases: null is as empty and has no ids; strings of special tokens are ordinary text; rows are encoded one by
one, so ties and repeated rows need no care.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches, tidy

#: Pieces whose ids a task keeps (some 400 bytes each).
CACHED_PIECES = 400_000
#: Bytes of the longest pieces that are kept.
CACHED_LENGTH = 64
#: Stands for no pair; ranks stay below it, and ranks times CACHED_LENGTH below NONE.
NO_RANK = 1 << 24
NONE = (1 << 31) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    none = 1 << 62
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i  # the least of these is the leftmost pair of least rank
    for p in range(size - 1, 0, -1):
        a, b = tree[2 * p], tree[2 * p + 1]
        tree[p] = a if a < b else b
    end = list(range(1, n + 1))  # of the live part that starts here
    before = list(range(-1, n))

    def put(i: int, value: int) -> None:
        p = size + i
        tree[p] = value
        p >>= 1
        while p:
            a, b = tree[2 * p], tree[2 * p + 1]
            least = a if a < b else b
            if tree[p] == least:
                return
            tree[p] = least
            p >>= 1

    while (top := tree[1]) < none:
        i = top % n
        j = end[i]
        stop = end[i] = end[j]
        before[stop] = i
        if j < n - 1:
            put(j, none)
        if i < n - 1:
            r = get(piece[i : end[stop]]) if stop < n else None
            put(i, none if r is None else r * n + i)
        if (k := before[i]) >= 0:
            r = get(piece[k:stop])
            put(k, none if r is None else r * n + k)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class PairRanks:
    """The rank of the token that two tokens make, by their ranks; for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        key = (np.array(left, dtype=np.int64) << 32) | np.array(right, dtype=np.int64)
        order = np.argsort(key)
        self.keys, self.made = np.append(key[order], 1 << 62), np.append(np.array(made, dtype=np.int32)[order], np.int32(NO_RANK))
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], np.int32(NO_RANK))


def merge_many(pieces: list[bytes], leaves: int, pairs: PairRanks) -> list[tuple[int, ...]]:
    """As merge, for pieces of 2 to leaves bytes (a power of two): one segment tree each, all updated together.

    Here a piece that is a token as a whole is merged like any other.
    """
    m = len(pieces)
    lengths = np.array([len(p) for p in pieces], dtype=np.int32)
    raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), dtype=np.uint8).reshape(m, leaves)
    column = np.arange(leaves, dtype=np.int32)
    ids = pairs.of_byte[raw]
    after = np.arange(1, leaves + 2, dtype=np.int32)  # the next live position; position leaves stands for none
    after = np.where(after >= lengths[:, None], np.int32(leaves), after)
    before = np.tile(np.arange(-1, leaves, dtype=np.int32), (m, 1))
    live = column[None, :] < lengths[:, None]
    tree = np.full((m, 2 * leaves), NONE, dtype=np.int32)
    two = column[None, : leaves - 1] + 1 < lengths[:, None]
    rank = pairs(ids[:, :-1], ids[:, 1:])
    tree[:, leaves : 2 * leaves - 1] = np.where(two & (rank < NO_RANK), rank * leaves + column[: leaves - 1], NONE)
    half = leaves // 2
    while half:
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        half //= 2
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        top = tree[rows, 1]
        i = top % leaves
        ids[rows, i] = top // leaves
        j = after[rows, i]
        k = after[rows, j]
        live[rows, j] = False
        after[rows, i] = k
        before[rows, k] = i
        h = before[rows, i]
        tree[rows, leaves + j] = NONE
        has = k < leaves
        rank = pairs(ids[rows, i], ids[rows, np.minimum(k, leaves - 1)])
        tree[rows, leaves + i] = np.where(has & (rank < NO_RANK), rank * leaves + i, NONE)
        has = h >= 0
        rank = pairs(ids[rows, h], ids[rows, i])
        left, at = rows[has], h[has]
        tree[left, leaves + at] = np.where(rank[has] < NO_RANK, rank[has] * leaves + at, NONE)
        r, p = np.concatenate([rows, rows, left]), np.concatenate([j, i, at]) + leaves
        while True:
            p = p >> 1
            if not p[0]:
                break
            tree[r, p] = np.minimum(tree[r, 2 * p], tree[r, 2 * p + 1])
        rows = rows[tree[rows, 1] < NONE]
    flat = ids[live].tolist()
    ends = np.cumsum(live.sum(axis=1)).tolist()
    return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]


class Pieces(dict):
    """Piece to (ids, decimal ids joined by commas); bounded."""

    def __init__(self, ranks: dict[bytes, int], limit: int = CACHED_PIECES):
        self.ranks, self.limit, self.pairs = ranks, limit, PairRanks(ranks)
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def entry(self, ids: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
        return ids, ",".join(map(str, ids))

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], str]:
        return self.entry(tuple(merge(piece.encode(), self.ranks)))

    def learn(self, pieces: set[str]) -> None:
        """Computes new pieces together; long ones are left to __missing__ and not kept. When full, only pieces in use stay."""
        if len(self) > self.limit:
            used = {p: self[p] for p in pieces if p in self}
            self.clear()
            self.update(used)
        by_leaves: dict[int, list[tuple[str, bytes]]] = {4: [], 8: [], 16: [], 32: [], 64: []}
        for piece in [p for p in pieces if p not in self]:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self[piece] = self.entry((whole,))
            elif len(raw) <= CACHED_LENGTH:
                by_leaves[max(4, 1 << (len(raw) - 1).bit_length())].append((piece, raw))
        for leaves, found in by_leaves.items():
            for at in range(0, len(found), 4096):
                part = found[at : at + 4096]
                for (piece, _), ids in zip(part, merge_many([raw for _, raw in part], leaves, self.pairs)):
                    self[piece] = self.entry(ids)


class Splitter:
    """Cuts texts by the pattern. Where the standard library's classes agree with \\p{L}, \\p{N} and \\s on all characters of a text, all within 16 bits, its faster engine is used."""

    def __init__(self, pattern: str):
        self.slow, self.fast, self.odd = regex.compile(pattern).findall, None, None
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        if r"\p" not in plain:
            every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
            odd: set[str] = set()
            for a, b in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
                odd |= set(regex.findall(a, every)) ^ set(re.findall(b, every))
            self.fast = re.compile(plain).findall
            self.odd = re.compile("[" + "".join(map(re.escape, sorted(odd))) + "\U00010000-\U0010ffff]").search

    def __call__(self, text: str) -> list[str]:
        return self.slow(text) if self.fast is None or self.odd(text) else self.fast(text)


class Tokenizer:
    """Encodes and decodes whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find, self.pieces = Splitter(pattern), Pieces(ranks)

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        for own in self.entries(texts):
            yield list(chain.from_iterable(x[0] for x in own))

    def entries(self, texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[tuple]]:
        """The entries of each text's pieces, in order; the new pieces of some texts at a time are merged together."""
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and size < chars:
                part.append(self.find(texts[at]) if texts[at] else [])
                size += len(texts[at] or "")
                at += 1
            self.pieces.learn(set(chain.from_iterable(part)))
            for own in part:
                yield list(map(self.pieces.__getitem__, own))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.bytes_of.__getitem__, ids))


#: The tokenizer of this worker process, by its vocabulary and pattern; later tasks use it again.
_HELD: dict[tuple[str, str], Tokenizer] = {}


def _tokenizer(ranks, path: str, pattern: str) -> Tokenizer:
    if (path, pattern) not in _HELD:
        _HELD.clear()
        _HELD[path, pattern] = Tokenizer(ranks.value, pattern)
    return _HELD[path, pattern]


def _each(ranks, path: str, pattern: str, row):
    """Applies row(tokenizer, batch) to each batch; ranks is a broadcast of bounded size (one vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(ranks, path, pattern)
        try:
            for batch in batches:
                yield from row(tokenizer, batch)
        finally:
            tokenizer.pieces.clear()  # an idle worker would hold up to 160 MB of them

    return run


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and ids (array of int). One pass without a shuffle; other columns are not read."""

    def row(t: Tokenizer, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(t.encode_all(batch.column(1).to_pylist())), pa.list_(pa.int32()))], ["id", "ids"])

    return _mapped(docs, path, pattern, id_col, text_col, row, "ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the decoded bytes; a null list of ids gives none."""

    def row(t: Tokenizer, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["id", "bytes"])

    return _mapped(tokens, path, pattern, id_col, ids_col, row, "bytes binary", "array<int>")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, the SHA-256 of its ids (decimal, comma-joined) and that of the bytes decoded from them."""

    def row(t: Tokenizer, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, a, b = [], [], []
        for own in t.entries(batch.column(1).to_pylist()):
            ids = list(chain.from_iterable(x[0] for x in own))
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(x[1] for x in own).encode()).hexdigest())
            b.append(hashlib.sha256(t.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, path, pattern, id_col, text_col, row, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(df: DataFrame, path: str, pattern: str, id_col: str, in_col: str, row, schema: str, kind: str = "string") -> DataFrame:
    small_batches(df.sparkSession)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(path))
    own = df.select(F.col(id_col).alias("id"), F.col(in_col).cast(kind).alias("value"))
    return own.mapInArrow(tidy(_each(ranks, path, pattern, row)), f"id {df.schema[id_col].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)
