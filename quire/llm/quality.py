"""Quality rules as a short-circuit cascade.

Each rule looks at a few measures of a text and rejects it or not; a text is kept if no rule rejects it. Measures are
computed when a rule first asks for them. The cost of each rule and the share that it rejects are estimated on a
bounded sample, and the rules run by rejections per second, the most first; a text leaves at its first rejection.
The order changes only the time, never the verdict.

Words are `[^\\x20\\x09-\\x0D]+`. Defined cases: a null text has no words and is rejected; every rule is a ratio whose
denominator is at least one; rows are judged one by one, so ties and repeated rows need no care.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
SPACES = b" \t\n\x0b\x0c\r"
#: Rows of the sample on which costs and rejections are estimated.
SAMPLE_ROWS = 1000


class Measures:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # on exactly the six separators

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        raw = self.raw
        return len(self.text) - (len(raw) - len(raw.translate(None, SPACES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw.translate(None, _NOT_SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        found = Counter(windows)
        total, covered = 0, 0
        for i, x in enumerate(windows):
            if found[x] > 1:
                total += i + 3 - max(covered, i)
                covered = i + 3
        return total

    @cached_property
    def n_upper_words(self) -> int:
        """Words of two bytes or more with a capital of A-Z and no letter of a-z."""
        return sum(1 for w in self.words if w.isupper() and len(w) > 1)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


def _few_words(m: Measures) -> bool:
    return m.n_words < 50


def _repeats(m: Measures) -> bool:
    return 100 * m.n_repeat_words > 50 * m.n_words


def _symbols(m: Measures) -> bool:
    return 10 * m.n_symbols > max(1, m.n_words)


def _shouting(m: Measures) -> bool:
    return 10 * m.n_upper_words > 3 * max(1, m.n_words)


def _dup_lines(m: Measures) -> bool:
    return 2 * m.n_dup_lines > max(1, len(m.lines))


def _word_length(m: Measures) -> bool:
    return not 2 * max(1, m.n_words) <= m.word_chars <= 20 * max(1, m.n_words)


BASE_RULES = (Rule("few_words", _few_words), Rule("repeated_words", _repeats))
RULES = (*BASE_RULES, Rule("symbols", _symbols), Rule("shouting", _shouting), Rule("repeated_lines", _dup_lines), Rule("word_length", _word_length))


def first_rejection(m: Measures, rules: tuple[Rule, ...]) -> str | None:
    return next((r.name for r in rules if r.rejects(m)), None)


def ordered_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections per second on about sample_rows rows, drawn evenly from all. The order decides only the cost."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(F.col(text_col).cast("string").alias("text")).sample(share, seed=11).collect()
    rate = {}
    for r in rules:
        hits, began = 0, time.perf_counter()
        for row in sample:
            hits += r.rejects(Measures(row["text"]))  # each rule pays for all that it needs
        rate[r.name] = (hits + 0.5) / (time.perf_counter() - began + 1e-9)
    return tuple(sorted(rules, key=lambda r: -rate[r.name]))


def _judge(rules: tuple[Rule, ...], base: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        for batch in batches:
            out: dict[str, list] = {x: [] for x in (*names, "base_failed", "kept")}
            for text in batch.column(1).to_pylist():
                m = Measures(text)
                kept = first_rejection(m, rules) is None
                for x in names:
                    out[x].append(getattr(m, x))
                out["base_failed"].append(any(r.rejects(m) for r in base))
                out["kept"].append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[x], pa.int64()) for x in names), pa.array(out["base_failed"], pa.bool_()), pa.array(out["kept"], pa.bool_())], ["id", *names, "base_failed", "kept"])

    return run


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Per document: id, the measures, base_failed and kept. One pass without a shuffle; other columns are not read."""
    small_batches(docs.sparkSession)
    order = ordered_rules(docs, text_col, rules)
    kind = docs.schema[id_col].dataType.simpleString()
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    df = df.mapInArrow(_judge(order, base), f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
    return df.withColumnRenamed("id", id_col)


def kept_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects; the cascade alone, without the measures."""
    small_batches(docs.sparkSession)
    order, place = ordered_rules(docs, text_col, rules), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([first_rejection(Measures(t), order) is None for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
