"""A line of JSON as Python sees it: used on the sample, by full inference and
for lines that Catalyst's JSON functions read differently (repeated keys)."""

from __future__ import annotations

import json
from collections.abc import Iterator

from ..plans.config import FLATTEN_DEPTH, LogicalType
from .timestamps import timestamp_micros_py

NOT_OBJECT = "top-level value is not an object"
BAD_JSON = "invalid JSON"
MISFIT = "value does not fit fixed schema column"
T = LogicalType


class BadLine(ValueError):
    pass


class Pairs(list):
    """An object's members in order, repeats included."""


def _reject(name: str):
    raise BadLine(BAD_JSON)


_DECODER = json.JSONDecoder(object_pairs_hook=Pairs, parse_constant=_reject)


def parse_object(line: str) -> Pairs:
    try:
        value = _DECODER.decode(line)
    except (ValueError, RecursionError) as e:
        raise e if isinstance(e, BadLine) else BadLine(BAD_JSON) from None
    if not isinstance(value, Pairs):
        raise BadLine(NOT_OBJECT)
    if any(k == "" for k, _ in value):
        raise BadLine("empty key")
    return value


def first_wins(value):
    """The same value as plain dicts and lists, the first of repeated keys kept."""
    if isinstance(value, Pairs):
        out: dict = {}
        for k, v in value:
            if k not in out:
                out[k] = first_wins(v)
        return out
    return [first_wins(v) for v in value] if isinstance(value, list) else value


def has_repeats(value) -> bool:
    if isinstance(value, Pairs):
        keys = [k for k, _ in value]
        return len(set(keys)) < len(keys) or any(has_repeats(v) for _, v in value)
    return isinstance(value, list) and any(has_repeats(v) for v in value)


def merged(obj: Pairs, depth: int = 1, prefix: str = "", out: dict | None = None) -> dict:
    """Values by dotted path, as ``walk`` finds them; the first of each path stays."""
    out = {} if out is None else out
    for key, v in obj:
        path = f"{prefix}.{key}" if prefix else key
        if isinstance(v, Pairs) and depth < FLATTEN_DEPTH:
            merged(v, depth + 1, path, out)
        elif path not in out:
            out[path] = first_wins(v)
    return out


def compact(value) -> str:
    return json.dumps(first_wins(value), separators=(",", ":"), ensure_ascii=False)


def wrap_int(n: int) -> int | None:
    """64-bit rule: up to 2^64 wraps into the signed range, beyond is null."""
    if -(2**63) <= n < 2**63:
        return n
    return n - 2**64 if 0 < n < 2**64 else None


def walk(obj: Pairs, depth: int = 1, prefix: str = "") -> Iterator[tuple[str, LogicalType, object]]:
    """Leaves as (dotted path, type, value); paths have four segments at most."""
    for key, v in obj:
        path = f"{prefix}.{key}" if prefix else key
        if isinstance(v, Pairs) and depth < FLATTEN_DEPTH:
            yield from walk(v, depth + 1, path)
        elif isinstance(v, list):
            yield path, T.STRING, compact(v)
        elif v is None:
            yield path, T.NULL, None
        elif isinstance(v, bool):
            yield path, T.BOOL, v
        elif isinstance(v, int):
            n = wrap_int(v)
            yield path, T.NULL if n is None else T.INT64, n
        elif isinstance(v, float):
            yield path, T.DOUBLE, v
        else:
            yield path, T.STRING, v


def leaves(obj: Pairs) -> dict[str, tuple[LogicalType, object]]:
    """By path; the first of those that share a path stays. A text that reads as a timestamp is typed so."""
    out: dict[str, tuple[LogicalType, object]] = {}
    for path, kind, v in walk(obj):
        if path not in out:
            raw_text = kind is T.STRING and isinstance(v, str)
            out[path] = (T.TIMESTAMP if raw_text and timestamp_micros_py(v) is not None else kind, v)
    return out
