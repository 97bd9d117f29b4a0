"""Which columns there are, and their types."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonwalk import BadLine, has_repeats, leaves, parse_object
from ..plans.config import ColumnSchema, Config, InferredSchema, LogicalType
from ..plans.schema import TypeConflictError, apply_projection, merge_override, resolve_types

_T = list(LogicalType)


def schema_from(seen: dict[str, set[LogicalType]], cfg: Config, rows: int, repeats: bool) -> InferredSchema:
    """A conflict that the error policy finds here makes a string column,
    unless ``strict_sample_errors``."""
    columns, conflicts = [], False
    for path, kinds in seen.items():
        try:
            kind = resolve_types(kinds, cfg.type_conflict)
        except TypeConflictError:
            if cfg.strict_sample_errors:
                raise
            kind = LogicalType.STRING
        conflicts |= len(kinds - {LogicalType.NULL}) > 1
        columns.append(ColumnSchema(path, kind))
    return InferredSchema(tuple(columns), rows, conflicts, repeats, seen)


def infer_lines(lines: Iterable[str], cfg: Config) -> InferredSchema:
    seen: dict[str, set[LogicalType]] = {}
    rows, repeats = 0, False
    for line in lines:
        try:
            obj = parse_object(line)
        except BadLine:
            continue
        rows += 1
        repeats = repeats or has_repeats(obj)
        for path, (kind, _) in leaves(obj).items():
            seen.setdefault(path, set()).add(kind)
    return schema_from(seen, cfg, rows, repeats)


def infer_all(lines: DataFrame, cfg: Config) -> InferredSchema:
    """The same over every line: a row for each path and task, then one for each path."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        rows, repeats = 0, False
        for batch in batches:
            srcs, blocks, seqs, values = (batch.column(i).to_pylist() for i in range(4))
            for src, block, seq, line in zip(srcs, blocks, seqs, values, strict=True):
                try:
                    obj = parse_object(line)
                except BadLine:
                    continue
                rows += 1
                repeats = repeats or has_repeats(obj)
                for place, (path, (kind, _)) in enumerate(leaves(obj).items()):
                    at = (src, block, seq, place)
                    if path not in found:
                        found[path] = [0, at]
                    elif at < found[path][1]:
                        found[path][1] = at
                    found[path][0] |= 1 << kind.code
        out = [(p, bits, *at, 0, False) for p, (bits, at) in found.items()] + [(None, 0, 0, "", 0, 0, rows, repeats)]
        names = ["path", "bits", "__src", "__block", "__seq", "place", "rows", "repeats"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    found = lines.select("__src", "__block", "__seq", "__line").mapInArrow(paths, "path string, bits bigint, __src int, __block string, __seq bigint, place bigint, rows bigint, repeats boolean")
    at = F.min(F.struct("__src", "__block", "__seq", "place")).alias("at")
    rows = found.groupBy("path").agg(F.bit_or("bits").alias("bits"), at, F.sum("rows").alias("rows"), F.max("repeats").alias("repeats")).collect()
    total = next((r for r in rows if r["path"] is None), None)
    ordered = sorted((r for r in rows if r["path"] is not None), key=lambda r: tuple(r["at"]))
    seen = {r["path"]: {k for k in _T if r["bits"] >> k.code & 1} for r in ordered}
    return schema_from(seen, cfg, total["rows"] if total else 0, bool(total and total["repeats"]))


def finish(schema: InferredSchema, cfg: Config) -> InferredSchema:
    return apply_projection(merge_override(schema, cfg.schema_override), cfg.projection)
