"""Operations out of delta messages, and their replay on a list of segments."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from quire.kernels import strictjson
from quire.kernels.segments import segment, utf16_length
from quire.model import ANNOTATE, INSERT, REMOVE


def _position(value: Any) -> int | None:
    return value if type(value) is int and 0 <= value < 1 << 63 else None


def _operation(node: dict[str, Any]) -> dict[str, Any] | None:
    """The operation that an object itself is."""
    kind, first, second = node.get("type"), _position(node.get("pos1")), _position(node.get("pos2"))
    if type(kind) is not int:
        return None
    if kind == INSERT and "seg" in node:
        seg = node["seg"]
        return {"kind": "insert", "pos1": first or 0, "pos2": None, "segments": [segment(x) for x in (seg if isinstance(seg, list) else [seg])], "props": None}
    if kind in (REMOVE, ANNOTATE) and first is not None and second is not None:
        props = node.get("props") if kind == ANNOTATE else None
        return {"kind": "remove" if kind == REMOVE else "annotate", "pos1": first, "pos2": second, "segments": None, "props": strictjson.dumps(props if isinstance(props, dict) else {}) if kind == ANNOTATE else None}
    return None


def operations(deltas: Iterable[str]) -> list[dict[str, Any]]:
    """All operations in reading order. The first address met is the channel, each deeper one the data structure; JSON held in a string value of an object is read too; messages that are not JSON are skipped."""
    out: list[dict[str, Any]] = []
    for delta in deltas:
        try:
            todo: list[tuple[Any, str | None, str | None]] = [(strictjson.loads(delta), None, None)]
        except ValueError:
            continue
        while todo:
            node, channel, structure = todo.pop()
            if isinstance(node, list):
                todo += [(x, channel, structure) for x in reversed(node)]
            if not isinstance(node, dict):
                continue
            address = node.get("address")
            if isinstance(address, str):
                channel, structure = (address, structure) if channel is None else (channel, address)
            op = _operation(node)
            if op is not None:
                out.append({"channel": channel, "data_structure": structure, **op})
                continue
            inner = []
            for value in node.values():
                if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
                    try:
                        value = strictjson.loads(value)
                    except ValueError:
                        continue
                inner.append((value, channel, structure))
            todo += reversed(inner)
    return [{"op_ordinal": i, **op} for i, op in enumerate(out)]


@dataclass
class Replayed:
    segments: list[dict[str, Any]]
    applied: int = 0
    skipped: int = 0
    warnings: list[str] = field(default_factory=list)


class Rope:
    """Segments in blocks of at most 2 * BLOCK, each with its UTF-16 length, so that an edit looks at block lengths and at one or two blocks."""

    BLOCK = 256

    def __init__(self, segments: Iterable[dict[str, Any]]):
        self.blocks: list[list[tuple[int, dict[str, Any]]]] = [[]]
        self.lengths = [0]
        self.insert((0, 0), segments)

    def find(self, position: int) -> tuple[tuple[int, int], int] | None:
        """((block, place), units) of the first segment that begins at the position, or that holds it units after its beginning; None beyond the end."""
        for b, length in enumerate(self.lengths):
            if position <= length:
                for i, (size, _) in enumerate(self.blocks[b]):
                    if not position or position < size:
                        return (b, i), position
                    position -= size
                if not position:
                    return (b, len(self.blocks[b])), 0
            else:
                position -= length
        return None

    def edge(self, position: int) -> tuple[int, int] | None:
        """The place at the position, a text being cut in two if it lies within; None beyond the end, within another kind of segment or within a character."""
        found = self.find(position)
        if found is None or not found[1]:
            return found and found[0]
        (b, i), units = found
        size, whole = self.blocks[b][i]
        text = whole.get("text") if whole["kind"] == "text" else None
        if text is None:
            return None
        head = text.encode("utf-16-le")[: 2 * units].decode("utf-16-le", "ignore")  # half a character is left out
        if utf16_length({"kind": "text", "text": head}) != units:
            return None
        self.blocks[b][i : i + 1] = [(units, whole | {"text": head}), (size - units, whole | {"text": text[len(head) :]})]
        return b, i + 1

    def insert(self, place: tuple[int, int], segments: Iterable[dict[str, Any]]) -> None:
        b, i = place
        new = [(utf16_length(s), s) for s in segments]
        self.blocks[b][i:i] = new
        whole = self.blocks[b]
        if len(whole) > 2 * self.BLOCK:
            self.blocks[b : b + 1] = [whole[k : k + self.BLOCK] for k in range(0, len(whole), self.BLOCK)]
            self.lengths[b : b + 1] = [sum(size for size, _ in block) for block in self.blocks[b : b + -(-len(whole) // self.BLOCK)]]
        else:
            self.lengths[b] += sum(size for size, _ in new)

    def remove(self, start: int, end: int) -> bool:
        """Removes [start, end), if there are edges at both; the one at the end may be made and stay even where the other can't be."""
        if end <= start or self.edge(end) is None or self.edge(start) is None:
            return False
        (b, i), (c, j) = self.find(start)[0], self.find(end)[0]
        left = self.blocks[b][:i] + self.blocks[c][j:]
        self.blocks[b : c + 1] = [left]
        self.lengths[b : c + 1] = [sum(size for size, _ in left)]
        return True

    def end(self) -> tuple[int, int]:
        return len(self.blocks) - 1, len(self.blocks[-1])

    def segments(self) -> list[dict[str, Any]]:
        return [s for block in self.blocks for _, s in block]


def _insert(rope: Rope, op: dict[str, Any]) -> str | None:
    place = rope.edge(op["pos1"])
    rope.insert(rope.end() if place is None else place, op["segments"])
    return None if place is not None else f"insert at {op['pos1']}: no such position in the text so far, so it went to the end"


def _remove(rope: Rope, op: dict[str, Any]) -> str | None:
    return None if rope.remove(op["pos1"], op["pos2"]) else f"remove of {op['pos1']} to {op['pos2']}: no such range in the text so far"


#: What each kind of operation does to the rope; it gives the reason if it could not be done as asked. Other kinds are skipped.
_EFFECTS = {"insert": _insert, "remove": _remove}


def replay(base: Iterable[dict[str, Any]], ops: Iterable[dict[str, Any]]) -> Replayed:
    """Applies inserts and removes in order. An insert past the end is appended and counts as skipped; annotations are skipped."""
    rope, count, reasons = Rope(base), {True: 0, False: 0}, []
    for op in ops:
        effect = _EFFECTS.get(op["kind"])
        reason = effect(rope, op) if effect else None
        count[effect is not None and reason is None] += 1
        if reason:
            reasons.append(reason)
    return Replayed(rope.segments(), count[True], count[False], reasons)
