"""Finds JSON objects around anchors in bytes that are not JSON as a whole."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from quire.kernels import envelope, strictjson
from quire.model import ANCHORS, Limits

#: What matters in an object: a whole string, a brace, or a quote without an end or a byte that JSON forbids.
_TOKEN = re.compile(rb'"(?:[^"\\\x00-\x1f]+|\\.)*"|([{}])|(["\x00-\x08\x0b\x0c\x0e-\x1f])', re.DOTALL)


@dataclass
class Payload:
    start: int
    end: int
    anchor: str
    value: dict[str, Any]


def match_object(data: bytes, start: int, budget: int) -> int | None:
    """The end of the object that opens at start: braces in strings don't count, a forbidden byte or an end beyond the budget gives none."""
    if data[start : start + 1] != b"{":
        return None
    stop, depth = min(len(data), start + budget), 0
    for m in _TOKEN.finditer(data, start, stop):
        if m[2]:
            return None
        depth += (m[1] == b"{") - (m[1] == b"}")
        if not depth:
            return m.end()
    return None


def _object(data: bytes, span: tuple[int, int]) -> dict[str, Any] | None:
    try:
        return strictjson.loads(data[slice(*span)])
    except ValueError:
        return None


class Fragments:
    """The nearest enclosing object that parses, for each anchor in turn."""

    name = "fragment-scanner"

    def __init__(self, anchors: tuple[str, ...] = ANCHORS, limits: Limits = Limits()):
        self.anchors, self.limits = anchors, limits

    def _openers(self, data: bytes, hit: int):
        """Positions of the braces to the left of hit, nearest first."""
        floor, at = max(0, hit - self.limits.lookback), hit
        for _ in range(self.limits.braces):
            at = data.rfind(b"{", floor, at)
            if at < 0:
                return
            yield at

    def _spans(self, data: bytes, hit: int) -> Iterator[tuple[int, int]]:
        """The balanced spans that hold hit, innermost first."""
        ends = ((start, match_object(data, start, self.limits.object_bytes)) for start in self._openers(data, hit))
        return ((start, end) for start, end in ends if end is not None and end > hit)

    def _hits(self, data: bytes) -> Iterator[tuple[str, int]]:
        return ((anchor, m.start()) for anchor in self.anchors for m in re.finditer(re.escape(anchor.encode()), data))

    def discover(self, data: bytes) -> list[Payload]:
        """Payloads by place. When the limit on their number is met, those found so far in order of discovery.

        A span is parsed once however many anchors it holds, and an anchor whose nearest brace opens a payload needs no search.
        """
        parsed: dict[tuple[int, int], dict | None] = {}
        found: dict[int, Payload] = {}  # by start: of a start, the budget and the bytes give one end
        for anchor, hit in self._hits(data):
            if len(found) >= self.limits.payloads:
                return list(found.values())
            if next(self._openers(data, hit), None) in found:
                continue
            for span in self._spans(data, hit):
                if span not in parsed:
                    parsed[span] = _object(data, span)
                if parsed[span] is not None:
                    found.setdefault(span[0], Payload(*span, anchor, parsed[span]))
                    break
        return [found[start] for start in sorted(found)]


class EnvelopeBlobs:
    """The blobs that the framing describes, where they are JSON objects; a cross-check of Fragments."""

    name = "envelope"

    def discover(self, data: bytes) -> list[Payload]:
        out = []
        for blob in envelope.read(data).blobs.values():
            try:
                value = strictjson.loads(data[blob.start : blob.start + blob.len])
            except ValueError:
                continue
            if isinstance(value, dict):
                out.append(Payload(blob.start, blob.start + blob.len, "envelope-blob", value))
        return sorted(out, key=lambda p: (p.start, p.end))


DISCOVERIES = {"fragment": Fragments, "envelope": EnvelopeBlobs}
