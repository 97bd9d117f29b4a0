"""The run: lines, schema, columns, error policy, sink, statistics."""

from __future__ import annotations

import time
import warnings
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonwalk import MISFIT
from ..functions.shared import stored
from ..plans.config import Config, ConversionError, ConvertStats, InferredSchema, LogicalType, NestedMode, OnError, ParseError, PipelineState, Projection, TypeConflict
from ..plans.schema import resolve_types
from ..sources.lines import expand, file_bytes, first_file_lines, first_lines, read_lines, with_line_numbers
from ..sources.sinks import write
from .extract import WORD, extract, misfit_kinds
from .infer import finish, infer_all, infer_lines
from .nested import extract_nested, infer_tree, infer_tree_all

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.variant.allowDuplicateKeys": "true",
}
_EXTRA = ("__src", "__block", "__seq", "__line", "_reason", "_misfit", "_repeats")
_PLACE = ("__src", "__block", "__seq")


@contextmanager
def settings(spark: SparkSession):
    """The session settings that a run needs; the caller's come back afterwards."""
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _source(spark: SparkSession, cfg: Config, lines: DataFrame | None) -> tuple[DataFrame, list[str], list[str]]:
    """Lines, the sample, and the files behind them."""
    if lines is not None:
        return lines, first_lines(lines, cfg.sample_lines), []
    files = expand(spark, cfg.inputs)
    df = read_lines(spark, files, cfg.max_line_bytes, cfg.missing_ok)
    return df, first_file_lines(spark, files, cfg.sample_lines, cfg.max_line_bytes), files


def _schema(lines: DataFrame, sample: list[str], cfg: Config) -> InferredSchema:
    return finish(infer_all(lines, cfg) if cfg.infer_scope == "full" else infer_lines(sample, cfg), cfg)


def infer_schema(spark: SparkSession, cfg: Config, lines: DataFrame | None = None) -> InferredSchema:
    with settings(spark):
        df, sample, _ = _source(spark, cfg, lines)
        return _schema(df, sample, cfg)


def _rows(spark: SparkSession, cfg: Config, lines: DataFrame | None) -> tuple[DataFrame, DataFrame, InferredSchema | None, list[str]]:
    df, sample, files = _source(spark, cfg, lines)
    if cfg.nested is NestedMode.NATIVE:
        if cfg.schema_override or cfg.projection != Projection() or cfg.type_conflict is not TypeConflict.WIDEN or cfg.threads > 1:
            warnings.warn("native nesting ignores schema, select, exclude, rename, type conflict and threads", stacklevel=3)
        tree = infer_tree_all(df) if cfg.infer_scope == "full" else infer_tree(sample)
        return df, extract_nested(df, tree), None, files
    schema = _schema(df, sample, cfg)
    return df, extract(df, schema, cfg.raw_json), schema, files


def _split(rows: DataFrame, cfg: Config) -> DataFrame:
    """``_reason`` also covers misfits where they make a line bad."""
    if not cfg.frozen_schema:
        return rows
    return rows.withColumn("_reason", F.coalesce("_reason", F.when(F.col("_misfit").isNotNull(), MISFIT)))


def _measures(schema: InferredSchema | None, cfg: Config) -> list[Column]:
    """What one pass counts; aggregates of fixed size."""
    bad = F.col("_reason").isNotNull()
    words = range(0 if cfg.frozen_schema or schema is None else -(-len(schema.columns) // WORD))
    first = [F.min(F.when(bad, F.struct(*_PLACE, "_reason"))).alias("first")] if cfg.on_error is OnError.ABORT else []
    return [
        F.count(F.lit(1)).alias("all"), F.count_if(bad).alias("bad"), F.max("_repeats").alias("repeats"),
        *[F.bit_or(F.get("_misfit", F.lit(i))).alias(f"w{i}") for i in words], *first,
    ]


def _revised(schema: InferredSchema | None, seen: dict, cfg: Config) -> InferredSchema | None:
    """The schema that a pass calls for, or None if it holds. A value that does
    not fit and can't widen its column raises."""
    if schema is None:
        return None
    if seen["repeats"] and not schema.duplicate_keys:
        return replace(schema, duplicate_keys=True)
    found = misfit_kinds([v for k, v in seen.items() if k[0] == "w"], schema)
    if not found:
        return None
    pinned = {c.name for c in cfg.schema_override}
    columns, known = list(schema.columns), dict(schema.seen)
    for i, kinds in found.items():
        c = columns[i]
        if cfg.infer_scope == "sample" or cfg.type_conflict is TypeConflict.ERROR or c.name in pinned:
            raise ConversionError(f"a value does not fit column {c.name}")
        known[c.json_path] = known.get(c.json_path, {c.type}) | kinds | {c.type}
        wider = resolve_types(known[c.json_path], cfg.type_conflict)
        # a column never narrows, so this ends
        columns[i] = replace(c, type=wider if c.type is not LogicalType.STRING else c.type)
    return replace(schema, columns=tuple(columns), seen=known)


def _names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in _EXTRA]


def _only(rows: DataFrame, keep: Column, names: list[str]) -> DataFrame:
    """Some rows' columns. A generator, not a filter: the optimizer would read
    every line a second time in a filter below."""
    if not names:
        return rows.filter(keep).select()
    return rows.select(F.inline(F.when(keep, F.array(F.struct(*[F.col(f"`{c}`") for c in names])))))


def to_dataframe(spark: SparkSession, cfg: Config, lines: DataFrame | None = None) -> DataFrame:
    """The typed rows. Bad lines are left out, or raise under ``abort``.

    The types must be settled before there is a DataFrame: unless they were
    inferred over every line, one scan looks for values that don't fit and for
    repeated keys. Rows are computed when they are asked for."""
    with settings(spark):
        df, rows, schema, _ = _rows(spark, cfg, lines)
        sure = schema is None or cfg.infer_scope == "full" and not cfg.schema_override
        while not sure:
            seen = _split(rows, cfg).agg(*_measures(schema, cfg)).first().asDict()
            if (new := _revised(schema, seen, cfg)) is None:
                break
            schema = new
            rows = extract(df, schema, cfg.raw_json)
        rows = _split(rows, cfg)
        keep = F.col("_reason").isNull()
        if cfg.on_error is OnError.ABORT:
            keep = F.when(keep, True).otherwise(F.raise_error(F.col("_reason")).cast("boolean"))
        return _only(rows, keep, _names(rows))


def collect_errors(spark: SparkSession, cfg: Config, lines: DataFrame | None = None) -> DataFrame:
    """Bad lines as ``(line_no bigint, reason string, raw string)``."""
    with settings(spark):
        df, rows, _, _ = _rows(spark, cfg, lines)
        return _errors(_split(rows, cfg), lines is None)


def _errors(rows: DataFrame, from_files: bool) -> DataFrame:
    """Places of all lines and the text of bad ones come from one pass: another
    could cut files elsewhere."""
    bad = F.col("_reason").isNotNull()
    return with_line_numbers(stored(rows.select(*_PLACE, F.col("_reason").alias("reason"), F.when(bad, F.col("__line")).alias("raw"))), from_files)


def convert(spark: SparkSession, cfg: Config, lines: DataFrame | None = None) -> ConvertStats:
    """Writes the output and reports. One pass over the data besides the sample:
    counts are observed while writing, and the output appears only if the run
    holds; another pass follows if types must widen."""
    began = time.time()

    def stats(state: PipelineState, reason: str = "", **more) -> ConvertStats:
        return ConvertStats(elapsed_ms=int((time.time() - began) * 1000), final_state=state, reason=reason, **more)

    with settings(spark):
        df, rows, schema, files = _rows(spark, cfg, lines)
        bytes_in = file_bytes(spark, files) if files else 0
        while True:
            out = _split(rows, cfg)
            names = _names(out)
            watch = Observation()
            held: dict = {}

            def holds(watch=watch, out=out, schema=schema, names=names, held=held) -> bool:
                held.update(watch.get if names else out.agg(*_measures(schema, cfg)).first().asDict())
                held["next"] = _revised(schema, held, cfg)
                return held["next"] is None and not (cfg.on_error is OnError.ABORT and held["bad"])

            good = out.observe(watch, *_measures(schema, cfg)).filter("_reason is null") if names else out
            try:
                bytes_out = write(good.select(*_PLACE, *[f"`{c}`" for c in names]), names, cfg, schema, holds)
            except ConversionError as e:
                return stats(PipelineState.ABORTED, str(e), bytes_in=bytes_in)
            if held["next"] is not None:
                schema = held["next"]
                rows = extract(df, schema, cfg.raw_json)
                continue
            break
        if bytes_out is None:
            return stats(PipelineState.ABORTED, held["first"]["_reason"], bytes_in=bytes_in)
        errors: tuple[ParseError, ...] = ()
        if cfg.on_error is OnError.COLLECT and held["bad"]:
            rest = _errors(out, bool(files)).orderBy("line_no").limit(cfg.max_errors).collect()
            errors = tuple(ParseError(r["line_no"], r["reason"], r["raw"]) for r in rest)
        n = held["all"] - held["bad"]
        return stats(PipelineState.DONE, rows_read=n, rows_written=n, rows_skipped=held["bad"], bytes_in=bytes_in, bytes_out=bytes_out, errors=errors)
