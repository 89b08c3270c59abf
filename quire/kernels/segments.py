"""Chunks, segments and their typed properties, out of parsed JSON."""

from __future__ import annotations

from typing import Any

from quire.kernels import strictjson
from quire.model import ATTRIBUTION, BOLD, ITALIC, LINK, LIST, NODE_TYPE, PLACEHOLDER, STYLE


def _as(kind: type, value: Any) -> Any:
    return value if type(value) is kind else None


def _segment(kind: str, props: dict | None, **own: Any) -> dict[str, Any]:
    p = props or {}
    out = dict.fromkeys(("text", "ref_type", "raw"))
    out |= {"kind": kind, "props": strictjson.dumps(p), "keys": list(p), "bold": _as(bool, p.get(BOLD)), "italic": _as(bool, p.get(ITALIC)), "attributed": ATTRIBUTION in p}
    for name, key in (("link", LINK), ("style", STYLE), ("list_ref", LIST), ("node_type", NODE_TYPE), ("placeholder", PLACEHOLDER)):
        out[name] = _as(str, p.get(key))
    return out | own


def segment(value: Any) -> dict[str, Any]:
    """A segment row: text (a bare string, or an object with a text), marker, or unknown with its raw JSON."""
    if isinstance(value, str):
        return _segment("text", None, text=value)
    if isinstance(value, dict):
        props = _as(dict, value.get("props"))
        if isinstance(value.get("text"), str):
            return _segment("text", props, text=value["text"])
        if "marker" in value:
            marker = value["marker"]
            ref = _as(int, marker.get("refType")) if isinstance(marker, dict) else None
            return _segment("marker", props, ref_type=ref if ref is not None and ref < 1 << 63 else None)
    return _segment("unknown", None, raw=strictjson.dumps(value)) | {"props": None}


#: Column, wire name and whether negative numbers are allowed.
_COUNTERS = (
    ("segment_count", "chunkSegmentCount", False),
    ("length_chars", "chunkLengthChars", False),
    ("total_length_chars", "totalLengthChars", False),
    ("total_segment_count", "totalSegmentCount", False),
    ("sequence_number", "chunkSequenceNumber", True),
)


def chunk(value: dict[str, Any]) -> dict[str, Any] | None:
    """The chunk that an object is, without its place and hash; None for other objects, and where a counter has a wrong type."""
    start, texts = value.get("chunkStartSegmentIndex", 0), value.get("segmentTexts")
    counters = {column: value.get(name) for column, name, _ in _COUNTERS}
    allowed = {column: negative for column, _, negative in _COUNTERS}
    if type(start) is not int or start < 0 or type(texts) is not list:
        return None
    for column, x in counters.items():
        if x is not None and (type(x) is not int or x >= 1 << 63 or (x < 0 and not allowed[column])):
            return None
    return {"start_index": start, **counters, "segments": [segment(x) for x in texts]}


def utf16_length(s: dict[str, Any]) -> int:
    """Positions that a segment takes: UTF-16 units of a text, one for anything else."""
    return len(s["text"].encode("utf-16-le")) // 2 if s["kind"] == "text" else 1
