"""JSON lines to typed columnar tables on Spark, plus a training-data toolkit.

``convert`` writes Parquet or the binary dump, ``to_dataframe`` gives the same
rows as a DataFrame, ``infer_schema`` gives the schema alone.
"""

from .operators.convert import convert, infer_schema, to_dataframe
from .plans.config import (
    ColumnSchema,
    Compression,
    Config,
    ConvertStats,
    InferredSchema,
    LogicalType,
    NestedMode,
    OnError,
    OutputFormat,
    ParseError,
    PipelineState,
    Projection,
    TypeConflict,
)

__version__ = "0.1.0"
__all__ = [
    "ColumnSchema", "Compression", "Config", "ConvertStats", "InferredSchema",
    "LogicalType", "NestedMode", "OnError", "OutputFormat", "ParseError",
    "PipelineState", "Projection", "TypeConflict", "convert", "infer_schema",
    "to_dataframe",
]
