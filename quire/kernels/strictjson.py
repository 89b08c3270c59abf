"""JSON as RFC 8259 has it: no NaN or Infinity, no lone surrogates, no overflowing floats, a bounded depth."""

from __future__ import annotations

import json
import math
import re
from typing import Any

from quire.model import JSON_DEPTH

_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|([\[{])|([\]}])', re.DOTALL)
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


def _float(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError("number out of range")
    return value


def _int(text: str) -> int | float:
    value = int(text) if len(text) < 21 else 1 << 65
    return value if -(1 << 63) <= value < 1 << 64 else _float(text)


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_float=_float, parse_int=_int)


def loads(data: bytes | str) -> Any:
    """The value; ValueError for anything that is not strict JSON."""
    text = data.decode() if isinstance(data, bytes) else data
    if text.count("[") + text.count("{") > JSON_DEPTH:
        depth = 0
        for m in _BRACKETS.finditer(text):
            depth += bool(m[1]) - bool(m[2])
            if depth > JSON_DEPTH:
                raise ValueError("nested too deeply")
    try:
        value, end = _DECODER.raw_decode(text, re.match(r"[ \t\n\r]*", text).end())
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    if text[end:].strip(" \t\n\r"):
        raise ValueError("trailing characters")
    if _SURROGATE.search(text):
        dumps(value).encode()  # UnicodeEncodeError is a ValueError
    return value


def dumps(value: Any) -> str:
    """Compact JSON in the order of insertion."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def pretty(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)
