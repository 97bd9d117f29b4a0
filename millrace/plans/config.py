"""What a run is told and what it reports: frozen values that check themselves."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

# Fixed values of the tool's contract.
BATCH_ROWS = 65_536
BATCH_BYTES = 256 * 1024 * 1024
SAMPLE_LINES = 10_000
MAX_LINE_BYTES = 64 * 1024 * 1024
FLATTEN_DEPTH = 4
EXIT_OK, EXIT_USAGE, EXIT_FAILED = 0, 2, 4


class LogicalType(str, Enum):
    """Column types; the position is the type byte of the binary dump."""

    INT64 = "int64"
    DOUBLE = "double"
    BOOL = "bool"
    STRING = "string"
    TIMESTAMP = "timestamp"
    NULL = "null"

    @property
    def code(self) -> int:
        return list(LogicalType).index(self)

    @property
    def spark(self) -> str:
        return {"int64": "bigint", "double": "double", "bool": "boolean", "timestamp": "timestamp"}.get(self.value, "string")


class OnError(str, Enum):
    SKIP = "skip"
    ABORT = "abort"
    COLLECT = "collect"


class TypeConflict(str, Enum):
    WIDEN = "widen"
    STRING = "string"
    ERROR = "error"


class NestedMode(str, Enum):
    FLATTEN = "flatten"
    NATIVE = "native"


class OutputFormat(str, Enum):
    PARQUET = "parquet"
    COLUMNAR_RAW = "columnar-raw"


class Compression(str, Enum):
    NONE = "none"
    SNAPPY = "snappy"
    ZSTD = "zstd"


class PipelineState(str, Enum):
    INIT = "INIT"
    DONE = "DONE"
    ABORTED = "ABORTED"


class ConversionError(RuntimeError):
    """A run that had to stop: the abort policy, or a value that no policy covers."""


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    type: LogicalType
    nullable: bool = True
    json_path: str | None = None

    def __post_init__(self):
        if not self.name:
            raise ValueError("column name must not be empty")
        if self.json_path is None:
            object.__setattr__(self, "json_path", self.name)


@dataclass(frozen=True)
class InferredSchema:
    columns: tuple[ColumnSchema, ...]
    sampled_rows: int = 0
    had_conflicts: bool = False
    duplicate_keys: bool = False
    #: path -> types it has held, as far as inference looked
    seen: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ValueError("column names must be unique")


@dataclass(frozen=True)
class Projection:
    select: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    rename: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class ParseError:
    line_no: int
    reason: str
    raw: str

    def __post_init__(self):
        if self.line_no < 1:
            raise ValueError("line numbers start at 1")
        if not self.reason:
            raise ValueError("an error needs a reason")


@dataclass(frozen=True)
class Config:
    """One run.

    ``infer_scope``: ``sample`` types columns from the first lines alone;
    ``auto`` (default) does the same, and when some later value does not fit,
    reads every line to widen those columns; ``full`` reads every line at once
    and keeps columns first seen after the sample, which the others drop.
    ``fixed_schema`` makes a value that does not fit its column a bad line (the
    rule of runs with several threads); without it such a value is fatal where
    widening is off. ``dump_magic`` opens the binary dump. ``single_file`` writes
    one file in the order of the input; ``ordered`` keeps a folder's files in it.
    ``max_errors`` bounds the errors in the statistics; ``collect_errors`` has all.
    """

    inputs: tuple[str, ...]
    output_path: str = ""
    output_format: OutputFormat = OutputFormat.PARQUET
    compression: Compression = Compression.ZSTD
    on_error: OnError = OnError.SKIP
    nested: NestedMode = NestedMode.FLATTEN
    type_conflict: TypeConflict = TypeConflict.WIDEN
    schema_override: tuple[ColumnSchema, ...] = ()
    projection: Projection = field(default_factory=Projection)
    batch_rows: int = BATCH_ROWS
    batch_bytes: int = BATCH_BYTES
    threads: int = 1
    print_schema: bool = False
    emit_stats: bool = False
    infer_scope: str = "auto"
    fixed_schema: bool | None = None
    sample_lines: int = SAMPLE_LINES
    max_line_bytes: int = MAX_LINE_BYTES
    strict_sample_errors: bool = False
    missing_ok: bool = False
    single_file: bool = False
    ordered: bool = False
    max_errors: int = 10_000
    raw_json: str = "compact"
    dump_magic: bytes = b"COLDUMP1"

    def __post_init__(self):
        for name, kind in (("output_format", OutputFormat), ("compression", Compression), ("on_error", OnError), ("nested", NestedMode), ("type_conflict", TypeConflict)):
            object.__setattr__(self, name, kind(getattr(self, name)))
        object.__setattr__(self, "inputs", tuple(self.inputs))
        object.__setattr__(self, "schema_override", tuple(self.schema_override))
        if not self.inputs:
            raise ValueError("at least one input is needed")
        if not self.output_path and not self.print_schema:
            raise ValueError("an output path is needed")
        if self.batch_rows < 1:
            raise ValueError("batch rows must be at least 1")
        if self.threads < 1:
            raise ValueError("threads must be at least 1")
        if self.nested is NestedMode.NATIVE and self.output_format is not OutputFormat.PARQUET:
            raise ValueError("native nesting needs parquet output")
        if self.infer_scope not in ("sample", "auto", "full"):
            raise ValueError("infer_scope is sample, auto or full")
        if len(self.dump_magic) != 8:
            raise ValueError("dump_magic has eight bytes")
        if self.raw_json not in ("compact", "verbatim"):
            raise ValueError("raw_json is compact or verbatim")

    @property
    def frozen_schema(self) -> bool:
        return self.threads > 1 if self.fixed_schema is None else self.fixed_schema


@dataclass(frozen=True)
class ConvertStats:
    rows_read: int = 0
    rows_written: int = 0
    rows_skipped: int = 0
    bytes_in: int = 0
    bytes_out: int = 0
    elapsed_ms: int = 0
    final_state: PipelineState = PipelineState.INIT
    errors: tuple[ParseError, ...] = ()
    reason: str = ""

    def __post_init__(self):
        if min(self.rows_read, self.rows_written, self.rows_skipped, self.elapsed_ms) < 0:
            raise ValueError("counts must not be negative")

    def line(self) -> str:
        return f"rows_read={self.rows_read} rows_written={self.rows_written} rows_skipped={self.rows_skipped} bytes_out={self.bytes_out} elapsed_ms={self.elapsed_ms}"

    @property
    def exit_code(self) -> int:
        return EXIT_OK if self.final_state is PipelineState.DONE else EXIT_FAILED
