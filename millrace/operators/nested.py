"""Native nesting: objects become structs, arrays become lists.

A tree of kinds is folded over the sample; ``from_json`` does the reading. It
nulls just the field whose value has another type, turns what is not a text
into compact JSON in text fields, and reads whole numbers into double fields.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonwalk import BadLine, Pairs, parse_object
from .extract import MARKS, line_reason, whole_object

# kinds: "null", "int", "double", "bool", "string", {"field": kind, ...}, [kind]


def kind_of(value):
    if isinstance(value, Pairs):
        out: dict = {}
        for k, v in value:
            if k not in out:
                out[k] = kind_of(v)
        return out
    if isinstance(value, list):
        inner = "null"
        for v in value:
            inner = unify(inner, kind_of(v))
        return [inner]
    if value is None:
        return "null"
    return {bool: "bool", int: "int", float: "double"}.get(type(value), "string")


def unify(a, b):
    """The narrowest kind that holds both."""
    if a == "null" or a == b:
        return b
    if b == "null":
        return a
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: unify(a[k], v) if k in a else v for k, v in b.items()}
    if isinstance(a, list) and isinstance(b, list):
        return [unify(a[0], b[0])]
    return "double" if {str(a), str(b)} == {"int", "double"} else "string"


def infer_tree(lines: Iterable[str]) -> dict:
    tree: dict = {}
    for line in lines:
        try:
            tree = unify(tree, kind_of(parse_object(line)))
        except BadLine:
            continue
    return tree


def to_spark(kind) -> T.DataType:
    if isinstance(kind, dict):
        # Parquet has no struct without fields: a member that never held any is left out
        fields = {k: to_spark(v) for k, v in kind.items()}
        return T.StructType([T.StructField(k, t) for k, t in fields.items() if not _hollow(t)])
    if isinstance(kind, list):
        return T.ArrayType(to_spark(kind[0]))
    return {"int": T.LongType(), "double": T.DoubleType(), "bool": T.BooleanType()}.get(kind, T.StringType())


def _hollow(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and not t.fields or isinstance(t, T.ArrayType) and _hollow(t.elementType)


def infer_tree_all(lines: DataFrame) -> dict:
    """The same over every line: a tree for each task, then one. Members are in the
    order of the tasks' first lines, so nearly that of the input."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: dict = {}
        first = None
        for b in batches:
            for src, block, seq, line in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                first = (src, block, seq) if first is None else min(first, (src, block, seq))
                try:
                    tree = unify(tree, kind_of(parse_object(line)))
                except BadLine:
                    continue
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*first, json.dumps(tree))], ["src", "block", "seq", "tree"])

    found = lines.select(*MARKS).mapInArrow(trees, "src bigint, block string, seq bigint, tree string")
    tree: dict = {}
    for row in found.orderBy("src", "block", "seq").toLocalIterator():  # a row a task
        tree = unify(tree, json.loads(row["tree"]))
    return tree


def extract_nested(lines: DataFrame, tree: dict) -> DataFrame:
    """As ``extract``, with structs and lists; a value of another type is null and
    no misfit. The line must be one whole object."""
    schema, line = to_spark(tree), F.col("__line")
    fields = schema if schema.fields else T.StructType([T.StructField("-", T.StringType())])
    read = lines.select(*MARKS, whole_object(line, fields).alias("_j"))
    out = read.select(*MARKS, line_reason(F.col("_j"), line).alias("_reason"), F.lit(None).cast("array<bigint>").alias("_misfit"), F.lit(False).alias("_repeats"), F.col("_j.row").alias("_row"))
    names = [f.name for f in schema.fields]
    return out.select(*MARKS, "_reason", "_misfit", "_repeats", *[F.col("_row").getField(n).alias(n) for n in names])
