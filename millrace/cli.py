"""Command line: ``python -m millrace.cli <inputs...> -o <output> [options]``."""

from __future__ import annotations

import sys
from collections.abc import Callable

from . import __version__
from .plans.config import EXIT_FAILED, EXIT_OK, EXIT_USAGE, Config, Projection
from .plans.schema_json import parse_schema_json, write_schema_json

HELP = """JSON lines to Parquet or a binary dump.

Usage: millrace <inputs...> -o <output> [options]
       millrace <inputs...> --print-schema
An input of '-' is standard input.

  -o, --output <path>         where to write (needed unless --print-schema)
      --format <fmt>          parquet, columnar-raw (parquet)
      --compression <codec>   none, snappy, zstd (zstd)
      --schema <file>         JSON schema that overrides inference
      --batch-rows <n>        rows a batch (65536)
      --batch-bytes <n>       bytes a batch (256 MiB)
      --threads <n>           more than 1 fixes the schema after the sample (1)
      --on-error <mode>       skip, abort, collect (skip)
      --type-conflict <rule>  widen, string, error (widen)
      --nested <mode>         flatten, native (flatten)
      --select <cols>         keep these columns, comma-separated
      --exclude <cols>        drop these columns
      --rename <from=to,...>  new names; may be repeated
      --print-schema          print the schema as JSON and stop
      --stats                 print statistics on standard error
  -h, --help                  this text
      --version               the version"""


class UsageError(ValueError):
    pass


def _csv(text: str) -> tuple[str, ...]:
    return tuple(x for x in text.split(",") if x)


def _pairs(text: str) -> tuple[tuple[str, str], ...]:
    out = []
    for item in _csv(text):
        old, eq, new = item.partition("=")
        if not (old and eq and new):
            raise UsageError(f"rename needs from=to: {item}")
        out.append((old, new))
    return tuple(out)


def _count(text: str) -> int:
    if not text.isdigit():
        raise UsageError(f"not a number: {text}")
    return int(text)


def parse_args(argv: list[str]) -> Config:
    """The run that the arguments ask for; UsageError if they make no sense."""
    given: dict = {}
    shape: dict = {"select": (), "exclude": (), "rename": ()}
    inputs: list[str] = []
    plain: dict[str, tuple[str, Callable]] = {
        "-o": ("output_path", str), "--output": ("output_path", str), "--format": ("output_format", str), "--compression": ("compression", str),
        "--on-error": ("on_error", str), "--nested": ("nested", str), "--type-conflict": ("type_conflict", str),
        "--batch-rows": ("batch_rows", _count), "--batch-bytes": ("batch_bytes", _count), "--threads": ("threads", _count),
    }
    flags = {"--stats": "emit_stats", "--print-schema": "print_schema"}
    rest = iter(argv)
    for arg in rest:
        if arg in flags:
            given[flags[arg]] = True
        elif arg in plain or arg in ("--schema", "--select", "--exclude", "--rename"):
            value = next(rest, None)
            if value is None:
                raise UsageError(f"{arg} needs a value")
            if arg in plain:
                name, read = plain[arg]
                given[name] = read(value)
            elif arg == "--schema":
                try:
                    with open(value, encoding="utf-8") as f:
                        given["schema_override"] = parse_schema_json(f.read()).columns
                except (OSError, ValueError) as e:
                    raise UsageError(f"schema: {e}") from None
            elif arg == "--rename":
                shape["rename"] += _pairs(value)
            else:
                shape[arg[2:]] = _csv(value)
        elif arg.startswith("-") and arg != "-":
            raise UsageError(f"unknown option: {arg}")
        else:
            inputs.append(arg)
    try:
        return Config(tuple(inputs), projection=Projection(**shape), **given)
    except ValueError as e:
        raise UsageError(str(e)) from None


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if "-h" in argv or "--help" in argv:
        print(HELP)
        return EXIT_OK
    if "--version" in argv:
        print(__version__)
        return EXIT_OK
    try:
        cfg = parse_args(argv)
    except UsageError as e:
        print(f"error: {e}", file=sys.stderr)
        return EXIT_USAGE
    from pyspark.sql import SparkSession

    from .operators.convert import convert, infer_schema

    spark = SparkSession.builder.appName("millrace").getOrCreate()
    try:
        if cfg.print_schema:
            print(write_schema_json(infer_schema(spark, cfg)))
            return EXIT_OK
        stats = convert(spark, cfg)
    except Exception as e:  # whatever stops a run is one line and one exit code
        print(f"error: {(str(e).strip() or type(e).__name__).splitlines()[0]}", file=sys.stderr)
        return EXIT_FAILED
    if cfg.emit_stats:
        print(stats.line(), file=sys.stderr)
    if stats.reason:
        print(f"error: {stats.reason}", file=sys.stderr)
    return stats.exit_code


if __name__ == "__main__":
    sys.exit(main())
