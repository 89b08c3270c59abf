"""Decodes the tagged framing of a member and indexes what it says about its blobs.

The stream is read by one loop with a stack of open containers. Tags: 01 zero; 03 05 07 unsigned integers of 1, 2, 4
bytes; 0b 0c 0d true, false, null; 0e 0f 10 strings and 21 22 23 blobs with a length of 1, 2, 4 bytes; 11 12 13
references to defined strings; 14 and 15 define a string (id and length of 1 or 4 bytes) and yield nothing; 31..32 array;
33..34 map.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from quire.kernels import strictjson
from quire.model import HANDLE_TYPE, MAX_DEPTH

_WIDTHS = (1, 2, 4)
_INTS = dict(zip((0x03, 0x05, 0x07), _WIDTHS))
_TEXTS = dict(zip((0x0E, 0x0F, 0x10), _WIDTHS))
_REFERENCES = dict(zip((0x11, 0x12, 0x13), _WIDTHS))
_DEFINITIONS = {0x14: 1, 0x15: 4}
_BLOBS = dict(zip((0x21, 0x22, 0x23), _WIDTHS))
_CONSTANTS = {0x01: 0, 0x0B: True, 0x0C: False, 0x0D: None}
_OPENERS = {0x31: 0x32, 0x33: 0x34}


class EnvelopeError(ValueError):
    pass


@dataclass(frozen=True)
class Blob:
    start: int
    len: int


class Pairs(list):
    """The (key, value) pairs of a map, in order; keys may repeat and need not be strings."""

    def get(self, name: str) -> Any:
        return next((v for k, v in self if isinstance(k, str) and k == name), None)


def parse(data: bytes) -> Any:
    """The first value of the member; what follows it is not looked at."""
    pos = 0
    names: dict[int, str] = {}
    stack: list[tuple[int, list]] = []  # closing tag and items read so far

    def number(width: int) -> int:
        nonlocal pos
        if pos + width > len(data):
            raise EnvelopeError(f"member ends part way through a value at offset {pos}")
        pos += width
        return int.from_bytes(data[pos - width : pos], "little")

    def span(length: int) -> int:
        nonlocal pos
        if pos + length > len(data):
            raise EnvelopeError(f"member ends part way through a value at offset {pos}")
        pos += length
        return pos - length

    def text(width: int) -> str:
        n = number(width)
        at = span(n)
        return data[at : at + n].decode("utf-8", "replace")

    while True:
        offset = pos
        tag = number(1)
        if tag in _DEFINITIONS:
            key = number(_DEFINITIONS[tag])
            names[key] = text(_DEFINITIONS[tag])
            continue
        if stack and tag == stack[-1][0] and (tag == 0x32 or len(stack[-1][1]) % 2 == 0):
            items = stack.pop()[1]
            value = items if tag == 0x32 else Pairs(zip(items[::2], items[1::2]))
        elif len(stack) > MAX_DEPTH:
            raise EnvelopeError(f"value nesting deeper than {MAX_DEPTH} levels")
        elif tag in _OPENERS:
            stack.append((_OPENERS[tag], []))
            continue
        elif tag in _CONSTANTS:
            value = _CONSTANTS[tag]
        elif tag in _INTS:
            value = number(_INTS[tag])
        elif tag in _TEXTS:
            value = text(_TEXTS[tag])
        elif tag in _REFERENCES:
            value = names.get(number(_REFERENCES[tag]), "")
        elif tag in _BLOBS:
            n = number(_BLOBS[tag])
            value = Blob(span(n), n)
        else:
            raise EnvelopeError(f"unknown tag 0x{tag:02x} at offset {offset}")
        if not stack:
            return value
        stack[-1][1].append(value)


@dataclass
class Index:
    paths: dict[str, str] = field(default_factory=dict)
    blobs: dict[str, Blob] = field(default_factory=dict)
    channels: dict[str, str] = field(default_factory=dict)
    handles: dict[str, str] = field(default_factory=dict)
    deltas: list[str] = field(default_factory=list)
    snapshot_seq: int | None = None
    first_delta_seq: int | None = None


def channel_segments(path: str) -> list[str]:
    """The path elements that follow a `.channels` element."""
    parts = [p for p in path.split("/") if p]
    return [b for a, b in zip(parts, parts[1:]) if a == ".channels"]


def _named(value: Any, name: str) -> Any:
    return value.get(name) if isinstance(value, Pairs) else None


def _whole(value: Any) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def _items(value: Any) -> list | None:
    return value if isinstance(value, list) and not isinstance(value, Pairs) else None


def read(data: bytes) -> Index:
    """The index of a member; EnvelopeError if it is no envelope."""
    root = parse(data)
    snapshot = root.get("snapshot") if isinstance(root, Pairs) and any(k == "snapshot" for k, _ in root if isinstance(k, str)) else _MISSING
    if snapshot is _MISSING:
        raise EnvelopeError("this member is not an envelope: no snapshot value")
    nodes = _items(_named(snapshot, "treeNodes"))
    if nodes is None:
        raise EnvelopeError("this member is not an envelope: no treeNodes array")
    out = Index()
    todo = [(node, "") for node in reversed(nodes)]
    while todo:
        node, above = todo.pop()
        name = _named(node, "name")
        if not isinstance(name, str):
            continue
        path = f"{above}/{name}"
        children, content = _items(_named(node, "children")), _named(node, "value")
        if children is not None:
            todo += [(child, path) for child in reversed(children)]
        elif isinstance(content, str):
            out.paths[content] = path
    for record in _items(_named(root, "blobs")) or []:
        key, blob = _named(record, "id"), _named(record, "data")
        if isinstance(key, str) and isinstance(blob, Blob):
            out.blobs[key] = blob
    out.snapshot_seq = _whole(_named(snapshot, "sequenceNumber"))
    deltas = _named(root, "deltas")
    out.first_delta_seq = _whole(_named(deltas, "firstSequenceNumber"))
    out.deltas = [x for x in _items(_named(deltas, "deltas")) or [] if isinstance(x, str)]
    for key in sorted(out.blobs):  # in byte order of the ids
        blob = out.blobs[key]
        try:
            value = strictjson.loads(data[blob.start : blob.start + blob.len])
        except ValueError:
            continue
        package, channels = component_package(value), channel_segments(out.paths.get(key, ""))
        if package is not None and channels:
            out.channels[channels[0]] = package
        out.handles.update(handles_of(value))
    return out


_MISSING = object()


def component_package(value: Any) -> str | None:
    """The last name in `pkg`, a JSON array of strings held in a string."""
    raw = value.get("pkg") if isinstance(value, dict) else None
    if not isinstance(raw, str):
        return None
    try:
        names = strictjson.loads(raw)
    except ValueError:
        return None
    return names[-1] if isinstance(names, list) and names and all(isinstance(x, str) for x in names) else None


def handles_of(value: Any) -> dict[str, str]:
    """Name to url of each `{value: {handle: {type, url}}}` at any depth; of equal names the last in reading order counts."""
    out: dict[str, str] = {}
    todo: list[tuple[str | None, Any]] = [(None, value)]
    while todo:
        name, node = todo.pop()
        if isinstance(node, dict):
            inner = node.get("value")
            handle = inner.get("handle") if isinstance(inner, dict) else None
            if name is not None and isinstance(handle, dict) and handle.get("type") == HANDLE_TYPE and isinstance(handle.get("url"), str):
                out[name] = handle["url"]
            todo += [(k, v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            todo += [(None, v) for v in reversed(node)]
    return out
