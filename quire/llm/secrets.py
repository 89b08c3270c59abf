"""Secret scan: fixed patterns, and formats learned by grammar inference (ALERGIA, Carrasco and Oncina, 1994).

Base spans, leftmost and without overlap for each kind: `assign` (a key word, a sign and a value of 6 characters or
more; the span is the whole match), `access` (AKIA and capitals or digits, 20 characters or more) and `hex` (24 or more
of 0-9a-f). The values found in all documents, a bounded number by hash, are labelled credentials: for each kind a prefix tree of
their character classes is built, its states are merged where their frequencies are statistically compatible, and the
result is a probabilistic automaton. What the base spans leave of the text is then cut into runs of
`[A-Za-z0-9+/_.=-]`; every run of LEAST characters or more is a candidate, and so is, where the run is none, each of its parts
between `=`, `/` and `.`. A candidate becomes a span of kind `format` if its likelihood per character under some automaton is at
least what nearly all labelled values reach, and above its likelihood as ordinary text. Base spans always stay.

Defined cases: null is as empty and has no spans; offsets are code points, the end exclusive; rows are judged one by
one; without any credential there is no automaton and no `format` span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import small_batches, tidy

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
PART = re.compile(r"[A-Za-z0-9+_-]{16,}")
LEAST = 16
#: Values of each kind, of all rows, that are learned from, by hash; and ordinary words, of the rows without any, that they are compared with.
SAMPLE_VALUES, ORDINARY_VALUES = 300, 3000
#: Rows of the sample in which ordinary words are looked for, and words of each, from anywhere in it, by hash.
SAMPLE_ROWS, ROW_WORDS = 20_000, 3
#: Confidence of ALERGIA's test that two states differ.
ALPHA = 0.05
#: Share of the labelled values that may score below the limit of their automaton.
TAIL = 0.02
#: Likelihood per character that a candidate must have above ordinary text.
MARGIN = 0.1
END = ""

_CLASS = {**{c: "d" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def labelled_values(text: str) -> list[tuple[str, str]]:
    """(kind, value) of the base spans: the value of an assignment is its right side."""
    out = [("assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", m[0]) for m in HEX.finditer(text)]


def shape(value: str) -> str:
    """Each character's class: d digit, h a-f, l g-z, U capital; other characters stand for themselves."""
    return "".join(_CLASS.get(c, c) for c in value)


@dataclass
class Automaton:
    """Deterministic probabilistic automaton: for each state the counts and targets of its symbols; END counts endings."""

    counts: list[Counter] = field(default_factory=lambda: [Counter()])
    target: list[dict[str, int]] = field(default_factory=lambda: [{}])
    limit: float = -math.inf

    def add(self, word: str) -> None:
        """Adds a word to the prefix tree."""
        state = 0
        for c in word:
            self.counts[state][c] += 1
            if c not in self.target[state]:
                self.target[state][c] = len(self.counts)
                self.counts.append(Counter())
                self.target.append({})
            state = self.target[state][c]
        self.counts[state][END] += 1

    def differ(self, a: Counter, b: Counter) -> bool:
        """Hoeffding's bound on the difference of the states' symbol shares."""
        n, m = sum(a.values()), sum(b.values())
        if not n or not m:
            return False
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(a[c] / n - b[c] / m) > bound for c in a.keys() | b.keys())

    def compatible(self, a: int, b: int) -> bool:
        stack, seen = [(a, b)], set()
        while stack:
            pair = stack.pop()
            if pair in seen:
                continue
            seen.add(pair)
            x, y = pair
            if self.differ(self.counts[x], self.counts[y]):
                return False
            stack += [(self.target[x][c], self.target[y][c]) for c in self.target[x].keys() & self.target[y].keys()]
        return True

    def fold(self, red: int, blue: int) -> None:
        """Adds the subtree of blue to red's states."""
        stack = [(red, blue)]
        while stack:
            x, y = stack.pop()
            if x == y:
                continue
            self.counts[x].update(self.counts[y])
            for c, child in self.target[y].items():
                if c in self.target[x]:
                    stack.append((self.target[x][c], child))
                else:
                    self.target[x][c] = child

    def infer(self) -> Automaton:
        """Merges each state next to the settled ones with the first settled state compatible with it, or settles it."""
        red = [0]
        while True:
            blue = [(x, c, y) for x in red for c, y in sorted(self.target[x].items()) if y not in red]
            if not blue:
                return self
            x, c, y = blue[0]
            for r in red:
                if self.compatible(r, y):
                    self.target[x][c] = r
                    self.fold(r, y)
                    break
            else:
                red.append(y)

    def likelihood(self, word: str) -> float:
        """Mean log-probability per symbol, with the ending; -inf for a word that leaves the language."""
        state, total = 0, 0.0
        for c in word:
            if c not in self.target[state]:
                return -math.inf
            total += math.log(self.counts[state][c] / sum(self.counts[state].values()))
            state = self.target[state][c]
        ending = self.counts[state]
        return (total + math.log((ending[END] + 0.01) / (sum(ending.values()) + 0.01))) / (len(word) + 1)


@dataclass
class Grammar:
    automata: dict[str, Automaton]
    ordinary: dict[str, float]  # log-probability of a class after another in ordinary words

    def text_likelihood(self, word: str) -> float:
        pairs = zip(f"^{word}", f"{word}$")
        return sum(self.ordinary.get(a + b, -8.0) for a, b in pairs) / (len(word) + 1)

    def is_credential(self, value: str) -> bool:
        word = shape(value)
        found = [x for a in self.automata.values() if (x := a.likelihood(word)) >= a.limit]
        return bool(found) and max(found) > self.text_likelihood(word) + MARGIN


def learn(values: dict[str, list[str]], ordinary: list[str]) -> Grammar:
    """One automaton for each kind of labelled values; ordinary holds words that are no credentials."""
    automata = {}
    for kind, own in sorted(values.items()):
        words = [shape(v) for v in own]
        a = Automaton()
        for w in words:
            a.add(w)
        a.infer()
        scores = sorted(a.likelihood(w) for w in words)
        a.limit = scores[int(TAIL * len(scores))]
        automata[kind] = a
    pairs: dict[str, Counter] = defaultdict(Counter)
    for w in map(shape, ordinary):
        for a_, b in zip(f"^{w}", f"{w}$"):
            pairs[a_][b] += 1
    logs = {a_ + b: math.log(n / sum(c.values())) for a_, c in pairs.items() for b, n in c.items()}
    return Grammar(automata, logs)


def all_spans(text: str, grammar: Grammar | None) -> list[tuple[int, int, int]]:
    """Base spans and learned ones, sorted by start and kind."""
    base = base_spans(text)
    if grammar is None or not grammar.automata:
        return base
    out, at = list(base), 0
    edges = sorted((s, e) for s, _, e in base)
    for s, e in [*edges, (len(text), len(text))]:
        if s > at:
            out += [(b, 3, e_) for b, e_ in formats(text, at, s, grammar)]
        at = max(at, e)
    return sorted(out)


def formats(text: str, start: int, end: int, grammar: Grammar) -> list[tuple[int, int]]:
    """The candidates of text[start:end] that are credentials."""

    def held(m: re.Match) -> tuple[int, int] | None:
        value = m[0].strip("./=-_+")
        begin = m.start() + m[0].index(value) if value else 0
        return (begin, begin + len(value)) if len(value) >= LEAST and grammar.is_credential(value) else None

    out = []
    for m in CANDIDATE.finditer(text, start, end):
        whole = held(m)
        out += [whole] if whole else [x for x in map(held, PART.finditer(text, *m.span())) if x and x != m.span()]
    return out


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """Learns from at most SAMPLE_VALUES values of each kind in all rows, and ordinary words of about sample_rows rows; both chosen by a hash.

    Values are ranked in blocks of hashes before the few that are left are ranked by kind.
    """
    small_batches(docs.sparkSession)
    n = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, drawn in zip(*(c.to_pylist() for c in batch.columns)):
                found = labelled_values(text)
                if drawn and not found:
                    found = [("", w) for w in sorted(set(ORDINARY.findall(text)), key=lambda w: (crc32(w.encode()), w))[:ROW_WORDS]]
                out += found
            yield pa.RecordBatch.from_pydict({"kind": [x[0] for x in out], "value": [x[1] for x in out]}, pa.schema([("kind", pa.string()), ("value", pa.string())]))

    h = F.xxhash64(F.col(id_col).cast("string"))
    drawn = h.cast("double") / F.lit(2.0**64) + 0.5 <= F.lit(min(1.0, sample_rows / max(1, n)))
    rows = docs.select(F.col(text_col).cast("string").alias("text"), drawn.alias("drawn")).where(F.col("text").isNotNull())
    found = rows.mapInArrow(tidy(run), "kind string, value string").distinct().withColumn("h", F.xxhash64("value"))
    wanted = F.when(F.col("kind") == "", ORDINARY_VALUES).otherwise(SAMPLE_VALUES)
    for block in (F.pmod("h", F.lit(64)), F.lit(0)):
        rank = F.row_number().over(Window.partitionBy("kind", block).orderBy("h", "value"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= wanted)
    values: dict[str, list[str]] = {}
    for r in found.orderBy("kind", "rank").collect():
        values.setdefault(r["kind"], []).append(r["value"])
    return learn({k: v for k, v in values.items() if k}, values.get("", []))


def _scan(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar: Grammar | None = held.value
        for batch in batches:
            n: list[list[int]] = [[], [], [], []]
            digest, names = [], []
            for text in batch.column(1).to_pylist():
                spans = all_spans(text or "", grammar)
                kinds = Counter(k for _, k, _ in spans)
                for k in range(4):
                    n[k].append(kinds[k])
                digest.append(hashlib.sha256(named([x for x in spans if x[1] < 3]).encode()).hexdigest())
                names.append(named(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(digest, pa.string()), pa.array(names, pa.string())], ["id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])

    return run


def scanned(docs: DataFrame, grammar: Grammar | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, counts by kind, the SHA-256 of its base spans, and all spans. One pass without a shuffle."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(grammar)
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    df = df.mapInArrow(tidy(_scan(held)), f"id {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")
    return df.withColumnRenamed("id", id_col)


def redact(text: str, grammar: Grammar | None, mark: str = "[secret]") -> str:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    out, at = [], 0
    for s, _, e in all_spans(text, grammar):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redacted_documents(docs: DataFrame, grammar: Grammar | None, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """docs with secrets replaced in its texts; chars_col, if there is one, is set to the new length. No row goes."""
    small_batches(docs.sparkSession)
    held, place = docs.sparkSession.sparkContext.broadcast(grammar), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if t is None else redact(t, held.value) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([texts if k == place else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    out = docs.mapInArrow(tidy(run), docs.schema)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col else out
