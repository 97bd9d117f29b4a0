"""The schema as one line of JSON, and back."""

from __future__ import annotations

import json

from pyspark.sql import types as T

from .config import ColumnSchema, InferredSchema, LogicalType


def parse_schema_json(text: str) -> InferredSchema:
    try:
        doc = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"schema is not valid JSON: {e}") from None
    columns = doc.get("columns") if isinstance(doc, dict) else None
    if not isinstance(columns, list):
        raise ValueError("schema needs an array named columns")
    out = []
    for c in columns:
        if not isinstance(c, dict) or not isinstance(c.get("name"), str) or not isinstance(c.get("type"), str):
            raise ValueError("every column needs a name and a type")
        try:
            kind = LogicalType(c["type"])
        except ValueError:
            raise ValueError(f"unknown type: {c['type']}") from None
        out.append(ColumnSchema(c["name"], kind, bool(c.get("nullable", True)), c.get("json_path")))
    return InferredSchema(tuple(out))


def write_schema_json(schema: InferredSchema) -> str:
    rows = [{"name": c.name, "type": c.type.value, "nullable": c.nullable, "json_path": c.json_path} for c in schema.columns]
    return json.dumps({"columns": rows}, separators=(",", ":"), ensure_ascii=False)


def to_struct_type(schema: InferredSchema) -> T.StructType:
    kinds = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "string": T.StringType()}
    return T.StructType([T.StructField(c.name, kinds[c.type.spark], True, {"json_path": c.json_path, "logical": c.type.value}) for c in schema.columns])
