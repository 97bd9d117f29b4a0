"""Lines of text as a DataFrame ``(__src int, __block string, __seq
long, __line string)``.

``__src`` is the input's place in the list, ``__block`` orders what Spark read in
one piece within it (file and start offset), ``__seq`` orders lines within a
block. Empty lines are gone and one trailing carriage return is stripped.
"""

from __future__ import annotations

import glob
import os
import re
import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import scratch
from ..plans.config import MAX_LINE_BYTES

SCHEMA = "__src int, __block string, __seq bigint, __line string"
_LINE = ("__src", "__block", "__seq", "__line")
#: A scheme before a path without a host, which is written with one slash or three.
_NO_HOST = "^([A-Za-z][A-Za-z0-9+.-]*):///"


def _clean(value: Column, cap: int) -> Column:
    """One trailing carriage return is stripped. An over-long line is cut at
    ``cap`` bytes (and then hardly parses); the rest of it is dropped."""
    head = F.make_valid_utf8(F.substring(value.cast("binary"), 1, cap).cast("string"))
    whole = F.when(F.octet_length(value) > cap, F.regexp_replace(head, "\ufffd$", "")).otherwise(value)
    return F.when(whole.endswith("\r"), F.left(whole, F.length(whole) - 1)).otherwise(whole)


def spool_stdin(spark: SparkSession) -> str:
    """Standard input, copied to the shared folder, where executors can read it
    more than once; it goes when the session ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "stdin"))
    f = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    while chunk := sys.stdin.buffer.read(1 << 20):
        f.write(bytearray(chunk))
    f.close()
    return path.toString()


def expand(spark: SparkSession, inputs: tuple[str, ...]) -> list[str]:
    """Local globs in name order; ``-`` is spooled; everything else is Spark's to open."""
    out: list[str] = []
    for path in inputs:
        if path == "-":
            out.append(spool_stdin(spark))
        elif "://" not in path and not os.path.exists(path) and (found := sorted(glob.glob(path))):
            out += found
        else:
            out.append(path)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def file_bytes(spark: SparkSession, inputs: list[str]) -> int:
    total = 0
    for path in inputs:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        total += sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(p) or [])
    return total


def _uri(spark: SparkSession, path: str) -> str:
    """A path as ``__uri`` has it."""
    return re.sub(_NO_HOST, r"\1:/", spark._jvm.org.apache.hadoop.fs.Path(path).toUri().toString())


def _listed(spark: SparkSession, path: str) -> list[str] | None:
    """The files of an input, or None if it has to be read by itself: it is
    missing, or a file's name would be taken for a pattern."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if found is None or not len(found):
        return None
    if len(found) == 1 and found[0].isFile():
        files = [found[0].getPath().toString()]
    else:
        jvm = spark._jvm
        files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in spark.read.text(path).inputFiles()]
    return None if any(set(f) & set("*?[]{}\\") for f in files) else files


def _read(spark: SparkSession, paths: list[str], max_line_bytes: int) -> DataFrame:
    # the default separator would also split on a lone carriage return
    raw = spark.read.option("lineSep", "\n").text(paths)
    at = F.concat_ws(":", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0"))
    df = raw.select(F.regexp_replace("_metadata.file_path", _NO_HOST, "$1:/").alias("__uri"), at.alias("__block"), _clean(F.col("value"), max_line_bytes).alias("__line"))
    return df.filter("__line <> ''").select("__uri", "__block", F.monotonically_increasing_id().alias("__seq"), "__line")


def read_lines(spark: SparkSession, inputs: list[str], max_line_bytes: int = MAX_LINE_BYTES, missing_ok: bool = False) -> DataFrame:
    """Plain, gzip and zstd files by suffix, in the order given. A missing input
    raises, or is empty under ``missing_ok``.

    However many inputs there are, the plan has one scan: a table of files says
    which input a line is of. A file that is given again is in another scan."""
    rounds: list[dict[str, tuple[str, int]]] = []
    alone = []
    for i, path in enumerate(inputs):
        if missing_ok and not _exists(spark, path):
            continue
        if (files := _listed(spark, path) if len(inputs) > 1 else None) is None:
            alone.append((i, path))
            continue
        for file in files:
            uri = _uri(spark, file)
            free = next((r for r in rounds if uri not in r), None)
            if free is None:
                rounds.append(free := {})
            free[uri] = (file, i)
    parts = [_read(spark, [path], max_line_bytes).withColumn("__src", F.lit(i)) for i, path in alone]
    for r in rounds:
        known = spark.createDataFrame([(uri, i) for uri, (_, i) in r.items()], "__uri string, _i int")
        lines = _read(spark, [file for file, _ in r.values()], max_line_bytes).join(F.broadcast(known), "__uri", "left")
        lost = F.raise_error(F.concat(F.lit("no input has the file "), F.col("__uri"))).cast("int")
        parts.append(lines.withColumn("__src", F.when(F.col("_i").isNull(), lost).otherwise(F.col("_i"))))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    out = parts[0].select(*_LINE)
    for p in parts[1:]:
        out = out.unionByName(p.select(*_LINE))
    return out


def lines_from_column(df: DataFrame, value: str, order: str, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """Lines already in a column, in the order of a bigint column of the same table."""
    df = df.select(F.lit(0).alias("__src"), F.lit("").alias("__block"), F.col(order).cast("bigint").alias("__seq"), _clean(F.col(value), max_line_bytes).alias("__line"))
    return df.filter("__line <> ''")


def _files(spark: SparkSession, path: str) -> list[str]:
    """Data files below an input, in name order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out: list[str] = []
    for status in fs.globStatus(p) or []:
        below = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [s.getPath().toString() for s in below if not s.isDirectory() and s.getPath().getName()[0] not in "._"]
    return sorted(out)


def first_file_lines(spark: SparkSession, inputs: list[str], n: int, max_line_bytes: int = MAX_LINE_BYTES) -> list[str]:
    """The first n lines in input order. One file after another is limited, so
    only the start of the data is read."""
    rows: list[str] = []
    for path in inputs:
        for file in _files(spark, path):
            if len(rows) >= n:
                return rows
            df = spark.read.option("lineSep", "\n").text(file).select(_clean(F.col("value"), max_line_bytes).alias("__line"))
            rows += [r[0] for r in df.filter("__line <> ''").limit(n - len(rows)).collect()]
    return rows


def first_lines(lines: DataFrame, n: int) -> list[str]:
    """The first n of lines that came from a column: a top-n by their order."""
    rows = lines.orderBy("__src", "__block", "__seq").limit(n).select("__line").collect()
    return [r[0] for r in rows]


def with_line_numbers(marked: DataFrame, from_files: bool) -> DataFrame:
    """(line_no, reason, raw) of the lines with a reason, counted from 1 over all
    lines. ``marked``: __src, __block, __seq, reason, raw of every line. Lines
    of a file have successive numbers within a block, so that counts by block suffice."""
    bad = marked.filter("reason is not null")
    if not from_files:
        from ..functions.order import with_position

        numbered = with_position(marked.select("__src", "__block", "__seq"), ["__src", "__block", "__seq"], "_pos")
        return bad.join(numbered, ["__src", "__block", "__seq"]).select((F.col("_pos") + 1).alias("line_no"), "reason", "raw")
    blocks = marked.groupBy("__src", "__block").agg(F.count(F.lit(1)).alias("_n"), F.min("__seq").alias("_first"))
    # one row a block of input
    earlier = Window.orderBy("__src", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return bad.join(starts, ["__src", "__block"]).select((F.col("_before") + F.col("__seq") - F.col("_first") + 1).alias("line_no"), "reason", "raw")
