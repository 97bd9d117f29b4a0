"""Where rows go: Parquet, or one self-describing binary file."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import stored
from ..plans.config import Compression, Config, ConversionError, InferredSchema, LogicalType, OutputFormat

PLACE = ("__src", "__block", "__seq")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _move(spark: SparkSession, old: str, new: str) -> None:
    fs, target = _fs(spark, new)
    fs.delete(target, True)
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(old), target):
        raise ConversionError(f"cannot move the output to {new}")


def _size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def _codec(cfg: Config) -> str:
    return "uncompressed" if cfg.compression is Compression.NONE else cfg.compression.value


def write_parquet(df: DataFrame, cfg: Config, holds: Callable[[], bool]) -> int | None:
    """Writes beside the target and moves it there if the run holds. Row groups
    have at most ``batch_rows`` rows and about ``batch_bytes`` bytes."""
    spark, tmp = df.sparkSession, f"{cfg.output_path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    fs, tmp_path = _fs(spark, tmp)
    try:
        out = df.coalesce(1) if cfg.single_file else df
        sized = out.write.option("compression", _codec(cfg)).option("parquet.block.row.count.limit", cfg.batch_rows)
        sized.option("parquet.block.size", max(1 << 16, min(cfg.batch_bytes, 128 << 20))).parquet(tmp)
        if not holds():
            return None
        if cfg.single_file:
            part = next(s.getPath().toString() for s in fs.listStatus(tmp_path) if s.getPath().getName().startswith("part-"))
            _move(spark, part, cfg.output_path)
        else:
            _move(spark, tmp, cfg.output_path)
    finally:
        fs.delete(tmp_path, True)
    return _size(spark, cfg.output_path)


def _put(spark: SparkSession, path: str, pieces: Iterator[bytes]) -> int:
    """One file of the given bytes, moved into place when it is whole."""
    tmp = f"{path}.tmp-{uuid.uuid4().hex}"
    fs, p = _fs(spark, tmp)
    try:
        f = fs.create(p)
        for raw in pieces:
            f.write(bytearray(raw))
        f.close()
        _move(spark, tmp, path)
    finally:
        fs.delete(p, True)
    return _size(spark, path)


# Values are little-endian after one byte that says null or not; a null has no more than that byte.
_FIXED = {T.LongType: "<i8", T.DoubleType: "<f8", T.BooleanType: "u1"}


def _encode(column: pa.Array, kind: T.DataType) -> bytes:
    if isinstance(kind, T.TimestampType):
        column, kind = column.cast(pa.int64()), T.LongType()
    if layout := _FIXED.get(type(kind)):
        rows = np.zeros(len(column), [("null", "u1"), ("value", layout)])
        gone = column.is_null().to_numpy(zero_copy_only=False)
        rows["null"] = gone
        rows["value"] = column.fill_null(False if layout == "u1" else 0).to_numpy(zero_copy_only=False)
        if not gone.any():
            return rows.tobytes()
        cells = rows.view("u1").reshape(len(rows), rows.dtype.itemsize)
        kept = np.ones(cells.shape, bool)
        kept[gone, 1:] = False
        return cells[kept].tobytes()
    out = bytearray()
    for v in column.to_pylist():
        if v is None:
            out += b"\x01"
        else:
            raw = v.encode()
            out += b"\x00" + struct.pack("<I", len(raw)) + raw
    return bytes(out)


def _batches(b: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows that end once they hold ``size`` bytes: a
    text counts its length and one, everything else nine."""
    cost = np.zeros(b.num_rows, np.int64)
    for c in b.columns:
        if pa.types.is_string(c.type):
            cost += 1 + pa.compute.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        else:
            cost += 9
    total = np.concatenate([[0], np.cumsum(cost)])
    start = 0
    while start < b.num_rows:
        end = min(start + rows, int(np.searchsorted(total, total[start] + size, "left")), b.num_rows)
        end = max(end, start + 1)
        yield b.slice(start, end - start)
        start = end


def _head(cfg: Config, columns: list[tuple[str, LogicalType]]) -> bytes:
    head = cfg.dump_magic + struct.pack("<I", len(columns))
    for name, kind in columns:
        raw = name.encode()
        head += struct.pack("<I", len(raw)) + raw + bytes([kind.code])
    return head


def write_dump(df: DataFrame, cfg: Config, schema: InferredSchema) -> int:
    """Executors encode batches and store them; the driver only appends their
    bytes, as the format is one file."""
    kinds, spark, rows, size = [f.dataType for f in df.schema.fields], df.sparkSession, cfg.batch_rows, cfg.batch_bytes

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _batches(whole, rows, size):
                raw = struct.pack("<I", b.num_rows) + b"".join(_encode(c, k) for c, k in zip(b.columns, kinds, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["block"])

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # dots in names would be read as fields
    blocks = stored(plain.mapInArrow(encode, "block binary").withColumn("at", F.monotonically_increasing_id()))

    def pieces() -> Iterator[bytes]:
        yield _head(cfg, [(c.name, c.type) for c in schema.columns])
        for row in blocks.orderBy("at").select("block").toLocalIterator(prefetchPartitions=True):
            yield row[0]

    return _put(spark, cfg.output_path, pieces())


def _write_empty(spark: SparkSession, cfg: Config) -> int:
    """Output without columns: a dump's head, or a Parquet file of no column."""
    if cfg.output_format is OutputFormat.COLUMNAR_RAW:
        return _put(spark, cfg.output_path, iter([_head(cfg, [])]))
    buffer = io.BytesIO()
    pq.write_table(pa.table({}), buffer)
    if cfg.single_file:
        return _put(spark, cfg.output_path, iter([buffer.getvalue()]))
    fs, p = _fs(spark, cfg.output_path)
    fs.delete(p, True)
    return _put(spark, f"{cfg.output_path.rstrip('/')}/part-00000.parquet", iter([buffer.getvalue()]))


def dump_head(spark: SparkSession, path: str) -> tuple[list[tuple[str, LogicalType]], int]:
    """Columns of a dump and where its batches start; only the head is read."""
    fs, p = _fs(spark, path)
    f = fs.open(p)
    try:
        f.readNBytes(8)
        n, at, columns = struct.unpack("<I", bytes(f.readNBytes(4)))[0], 12, []
        for _ in range(n):
            size = struct.unpack("<I", bytes(f.readNBytes(4)))[0]
            raw = bytes(f.readNBytes(size + 1))
            columns.append((raw[:size].decode(), list(LogicalType)[raw[size]]))
            at += 5 + size
    finally:
        f.close()
    return columns, at


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a binary dump; one file is one task, as it has no index, and has
    2 GB at most, as a row of bytes has."""
    columns, start = dump_head(spark, path)
    arrow = {"int64": pa.int64(), "double": pa.float64(), "bool": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
    types = [arrow.get(k.value, pa.string()) for _, k in columns]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                i = start
                while i < len(raw):
                    rows, i, out = struct.unpack_from("<I", raw, i)[0], i + 4, []
                    for (_, kind), t in zip(columns, types, strict=True):
                        values = []
                        for _ in range(rows):
                            null, i = raw[i], i + 1
                            if null:
                                values.append(None)
                            elif kind in (LogicalType.STRING, LogicalType.NULL):
                                size = struct.unpack_from("<I", raw, i)[0]
                                values.append(raw[i + 4 : i + 4 + size].decode())
                                i += 4 + size
                            elif kind is LogicalType.BOOL:
                                values.append(bool(raw[i]))
                                i += 1
                            else:
                                values.append(struct.unpack_from("<d" if kind is LogicalType.DOUBLE else "<q", raw, i)[0])
                                i += 8
                        out.append(pa.array(values, t))
                    yield pa.RecordBatch.from_arrays(out, [c for c, _ in columns])

    kinds = ", ".join(f"`{name}` {kind.spark}" for name, kind in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, kinds)


def write(rows: DataFrame, names: list[str], cfg: Config, schema: InferredSchema | None, holds: Callable[[], bool]) -> int | None:
    """Bytes written, or None if the run does not hold. ``rows``: the columns, and
    each row's place in the input. One file is in the order of the input, and so
    is a folder's list of files under ``ordered``: rows are then stored once
    before they are sorted."""
    spark = rows.sparkSession
    columns = [F.col(f"`{c}`") for c in names]
    if not names:
        return _write_empty(spark, cfg) if holds() else None
    dump = cfg.output_format is OutputFormat.COLUMNAR_RAW and schema is not None
    if not (dump or cfg.single_file or cfg.ordered):
        return write_parquet(rows.select(*columns), cfg, holds)
    kept = stored(rows)
    if not holds():
        return None
    sorted_rows = kept.orderBy(*PLACE).select(*columns)
    return write_dump(sorted_rows, cfg, schema) if dump else write_parquet(sorted_rows, cfg, lambda: True)
