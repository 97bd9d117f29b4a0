"""Decisions about columns, made on the driver over a handful of values."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from .config import ColumnSchema, InferredSchema, LogicalType, Projection, TypeConflict

T = LogicalType


class TypeConflictError(ValueError):
    pass


def resolve_types(seen: Iterable[LogicalType], policy: TypeConflict) -> LogicalType:
    """One type for what a path has held. Nulls don't count."""
    kinds = {LogicalType(t) for t in seen} - {T.NULL}
    if not kinds:
        return T.NULL
    if len(kinds) == 1:
        return kinds.pop()
    if policy is TypeConflict.ERROR:
        raise TypeConflictError(f"conflicting types: {sorted(k.value for k in kinds)}")
    return T.DOUBLE if policy is TypeConflict.WIDEN and kinds == {T.INT64, T.DOUBLE} else T.STRING


def merge_override(schema: InferredSchema, override: Iterable[ColumnSchema]) -> InferredSchema:
    """Known names take the given type and keep their path; others are appended."""
    cols = {c.name: c for c in schema.columns}
    for o in override:
        old = cols.get(o.name)
        cols[o.name] = ColumnSchema(o.name, o.type, o.nullable, old.json_path if old else o.json_path)
    return replace(schema, columns=tuple(cols.values()))


def apply_projection(schema: InferredSchema, p: Projection) -> InferredSchema:
    """select, then exclude, then the renames one after another."""
    cols = list(schema.columns)
    if p.select:
        by_name = {c.name: c for c in cols}
        if unknown := [n for n in p.select if n not in by_name]:
            raise ValueError(f"unknown column in select: {unknown[0]}")
        cols = [by_name[n] for n in p.select]
    cols = [c for c in cols if c.name not in set(p.exclude)]
    for old, new in p.rename:
        at = next((i for i, c in enumerate(cols) if c.name == old), None)
        if at is not None:
            c = cols[at]
            cols[at] = ColumnSchema(new, c.type, c.nullable, c.json_path)
    if len({c.name for c in cols}) != len(cols):
        raise ValueError("projection produced duplicate column names")
    return replace(schema, columns=tuple(cols))
