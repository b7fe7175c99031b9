"""JSON as the log's writers have it: strict on reading, compact on writing."""

from __future__ import annotations

import json
from typing import Any


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


#: Made once, as the encoders below: one for each text takes as long as a short text.
_STRICT = json.JSONDecoder(parse_constant=_no_constant)


def parse(text: str) -> Any:
    """Strict JSON: no NaN or Infinity, nothing behind the value; of equal keys the last counts."""
    try:
        return _STRICT.decode(text)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def _plain(value: Any) -> Any:
    """Whole floats as integers, as writers with one number type print them."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


_COMPACT = {ordered: json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=ordered).encode for ordered in (False, True)}


def dump(value: Any, ordered: bool = False) -> str:
    """Compact JSON, keys in their order or sorted; non-ASCII stays as it is."""
    return _COMPACT[ordered](_plain(value))


def number(value: Any) -> int | None:
    """A JSON number as an integer; anything else, also true and false, is absent."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if isinstance(value, float) and not value.is_integer():
        return None
    whole = int(value)
    return whole if -(1 << 63) <= whole < 1 << 63 else None


def string(value: Any) -> str | None:
    return value if isinstance(value, str) else None


def printed(value: Any, absent: str = "undefined") -> str:
    """A value inside a sentence: strings bare, other values as JSON, a missing one by name."""
    if value is None:
        return absent
    return value if isinstance(value, str) else dump(value)


def utf16_length(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(ord(c) > 0xFFFF for c in text)
