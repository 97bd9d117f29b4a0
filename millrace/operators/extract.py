"""From lines to typed columns.

Each line is read once by ``from_json`` with the resolved types, inside an outer
object whose second member shows that the line was one whole value. Where every
value was of its column's type and every text could only have been a text, that
reading stands. Other lines (a misfit, a number under a text column, a timestamp of an
unusual shape) are read as a variant, and the tag of each value decides; this
is one interpreted expression, evaluated for such lines alone.

The result has the columns, ``_reason`` (why the line is bad, or null),
``_misfit`` (types of values that do not fit, six bits a column, ten columns a
word; null if there are none) and ``_repeats`` (an object holds a key twice).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonwalk import BAD_JSON, NOT_OBJECT, BadLine, compact, has_repeats, merged, parse_object
from ..functions.numbers import six_decimals
from ..functions.timestamps import timestamp_micros, usual_micros
from ..plans.config import FLATTEN_DEPTH, ColumnSchema, InferredSchema, LogicalType

_BIG_INT = r"^DECIMAL\((19|[23]\d),0\)$"
#: What a number becomes in a text field, whole ones of up to 18 digits (the same either way) excepted.
_NUMBER_LIKE = r'^(?!(?:0|-?[1-9]\d{0,17})$)(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|"?-?Infinity"?|"?NaN"?)$'
JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
#: Columns of one word of ``_misfit``, and bits of one column.
WORD, BITS = 10, 6
MARKS = ("__src", "__block", "__seq", "__line")


def _step(key: str) -> str:
    return f"['{key}']" if "'" not in key else f'["{key}"]'


def _paths(json_path: str) -> list[str]:
    """As nested keys, and as one key that has dots."""
    keys = json_path.split(".")
    out = ["$" + "".join(map(_step, keys))]
    return out + ["$" + _step(json_path)] if len(keys) > 1 else out


def whole_object(line: Column, fields: T.StructType) -> Column:
    """``from_json`` of a line that must be one value and nothing else: members
    ``row`` (null unless it is an object), ``whole`` (null unless the line is
    valid) and ``bad`` (not null if anything did not fit)."""
    outer = T.StructType([T.StructField("row", fields), T.StructField("whole", T.IntegerType()), T.StructField("bad", T.StringType())])
    return F.from_json(F.concat(F.lit('{"row":'), line, F.lit(',"whole":1}')), outer, JSON_OPTIONS)


def line_reason(read: Column, line: Column) -> Column:
    """Why a line is bad, or null."""
    # "" as a key has no column name
    nameless = line.contains('"":') & F.array_contains(F.json_object_keys(line), "")
    return F.when(read["whole"].isNull(), BAD_JSON).when(read["row"].isNull(), NOT_OBJECT).when(nameless, "empty key")


@F.pandas_udf(T.StringType())
def _first_keys(lines: pd.Series) -> pd.Series:
    """Lines that repeat a key as the first value of each path; other lines stay."""

    def one(line: str | None) -> str | None:
        try:
            obj = parse_object(line or "")
        except BadLine:
            return line
        return compact(merged(obj)) if has_repeats(obj) else line

    return lines.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _spans(lines: pd.Series, paths: pd.Series) -> pd.Series:
    """The source texts of members, unchanged; ``paths`` is the same array in every row."""
    return pd.Series([None if line is None else [verbatim(line, p) for p in ps] for line, ps in zip(lines, paths, strict=True)], dtype=object)


def verbatim(line: str, path: str) -> str | None:
    """The text of the value at a dotted path as it stands in the line."""
    import json

    scan = json.JSONDecoder().raw_decode

    def skip(i: int) -> int:
        while i < len(line) and line[i] in " \t\r\n":
            i += 1
        return i

    def members(i: int) -> Iterator[tuple[str, int, int]]:
        i = skip(i + 1)
        while i < len(line) and line[i] == '"':
            key, i = scan(line, i)
            at = skip(skip(i) + 1)
            _, end = scan(line, at)
            yield key, at, end
            i = skip(end)
            i = skip(i + 1) if i < len(line) and line[i] == "," else len(line)

    def find(i: int, keys: list[str]) -> str | None:
        for n in range(len(keys), 0, -1) if len(keys) > 1 else (1,):
            for key, at, end in members(i):
                if key == ".".join(keys[:n]):
                    if n == len(keys):
                        return line[at:end]
                    if line[at] == "{" and (got := find(at, keys[n:])) is not None:
                        return got
        return None

    try:
        return find(skip(0), path.split("."))
    except (ValueError, IndexError, TypeError):
        return None


# -- the typed reading, as SQL text: plans of hundreds of columns are parsed at once ----

_FIELD = {LogicalType.INT64: T.LongType(), LogicalType.DOUBLE: T.DoubleType(), LogicalType.BOOL: T.BooleanType()}


def _name(key: str) -> str:
    return "`" + key.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tree(schema: InferredSchema) -> dict | None:
    """Fields by key, nested by path; None where one path is a value and an object,
    or where columns read one path as two types."""
    tree: dict = {}

    def put(keys: list[str], kind: T.DataType) -> bool:
        here = tree
        for key in keys[:-1]:
            here = here.setdefault(key, {})
            if not isinstance(here, dict):
                return False
        return here.setdefault(keys[-1], kind) == kind

    for c in schema.columns:
        kind, keys = _FIELD.get(c.type, T.StringType()), c.json_path.split(".")
        if not put(keys, kind) or len(keys) > 1 and not put([c.json_path], kind):
            return None
    return tree


def _struct(tree: dict) -> T.StructType:
    return T.StructType([T.StructField(k, _struct(v) if isinstance(v, dict) else v) for k, v in tree.items()])


def _members(tree: dict, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], bool]]:
    """Paths below a tree, and whether each is an object."""
    for k, v in tree.items():
        yield (*at, k), isinstance(v, dict)
        if isinstance(v, dict):
            yield from _members(v, (*at, k))


def _get(keys: tuple[str, ...] | list[str]) -> str:
    return ".".join(["_j.row", *map(_name, keys)])


def _typed(c: ColumnSchema) -> str:
    keys = c.json_path.split(".")
    return f"coalesce({_get(keys)}, {_get([c.json_path])})" if len(keys) > 1 else _get(keys)


def _doubtful(i: int, c: ColumnSchema, raw: str) -> str | None:
    """Whether a typed value needs the variant's word."""
    t, x = LogicalType, _typed(c)
    if c.type is t.DOUBLE:
        return f"coalesce(abs({x}) >= 9.223372036854775807E18D, false)"  # whole numbers from there on wrap or are null
    if c.type is t.TIMESTAMP:
        return f"({x} is not null and _m.m{i} is null)"
    if c.type is t.NULL:
        return f"{x} is not null"
    if c.type is not t.STRING:
        return None
    deep = len(c.json_path.split(".")) >= FLATTEN_DEPTH
    nested = (["["] if raw == "verbatim" else []) + (["{"] if raw == "verbatim" or not deep else [])
    number = "left({x}, 1) in ('-', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9', 'I', 'N', '\"') and {x} rlike {like}".format(x=x, like=_text(_NUMBER_LIKE))
    opened = f" or left({x}, 1) in ({', '.join(map(_text, nested))})" if nested else ""
    return f"coalesce({number}{opened}, false)"


def _repeats(tree: dict, known: bool = True) -> str:
    """Whether an object on the way to a column has a key twice. Most lines are
    settled by counting: as many keys in the line as members that were found."""
    objects = ["__line", *[f"get_json_object(__line, {_text('$' + ''.join(map(_step, path)))})" for path, inner in _members(tree) if inner]]
    twice = " or ".join(f"coalesce(size(array_distinct(json_object_keys({o}))) < size(json_object_keys({o})), false)" for o in objects)
    if not known:
        return f"({twice})"
    found = " + ".join(["0", *[f"int({_get(path)} is not null)" for path, _ in _members(tree)]])
    keys = """(octet_length(__line) - octet_length(replace(__line, '":', ''))) / 2"""
    spaced = "contains(__line, ' :') or contains(__line, '\\t:') or contains(__line, '\\r:')"
    return f"case when {keys} = {found} and not ({spaced}) then false else {twice} end"


# -- the reading by tags -------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tagged(x: Column) -> Column:
    """A variant in every form that a column may ask for, and the bit of its type
    (0 for null and for numbers beyond 64 bits)."""

    def read(tag: Column, micros: Column) -> Column:
        t = LogicalType
        get = lambda kind: F.try_variant_get(x, "$", kind)
        is_int, is_text, is_bool, is_list = tag == "BIGINT", tag == "STRING", tag == "BOOLEAN", tag.startswith("ARRAY")
        is_big = tag.rlike(_BIG_INT)
        is_double = (tag == "DOUBLE") | (tag.startswith("DECIMAL") & ~is_big)
        big, signed, unsigned = get("decimal(38,0)"), F.lit(2**63 - 1), F.lit(str(2**64)).cast("decimal(20,0)")
        whole = F.when(is_int, get("bigint")).when(is_big & (big > signed) & (big < unsigned), (big - unsigned).cast("bigint"))
        double = F.when(is_big, whole.cast("double")).when(is_int | is_double, get("double"))
        truth = F.when(is_bool, get("boolean"))
        shown = F.when(is_text, get("string")).when(is_int | is_big, whole.cast("string")).when(is_double, six_decimals(F.when(is_double, double))).when(is_bool, truth.cast("string"))
        kind = F.when(whole.isNotNull(), 1 << t.INT64.code).when(is_double, 1 << t.DOUBLE.code).when(is_bool, 1 << t.BOOL.code)
        kind = kind.when(is_text & micros.isNotNull(), 1 << t.TIMESTAMP.code).when(is_text | is_list, 1 << t.STRING.code).otherwise(0)
        return F.struct(kind.alias("kind"), whole.alias("int64"), double.alias("double"), truth.alias("bool"), shown.alias("string"), F.timestamp_micros(micros).alias("timestamp"), is_list.alias("list"), tag.startswith("OBJECT").alias("object"))

    def timed(tag: Column) -> Column:
        return _let(F.when(tag == "STRING", F.try_variant_get(x, "$", "string")), lambda text: _let(timestamp_micros(text), lambda micros: read(tag, micros)))

    return _let(F.schema_of_variant(x), timed)


def _by_tags(cols: tuple[ColumnSchema, ...]) -> Column:
    """What the line holds at each column's path, as ``_tagged`` says it."""

    def values(parsed: Column) -> Column:
        got = [[F.try_variant_get(parsed, p, "variant") for p in _paths(c.json_path)] for c in cols]
        return F.transform(F.array(*[F.coalesce(*g) if len(g) > 1 else g[0] for g in got]), _tagged)

    return _let(F.try_parse_json(F.col("__line")), values)


def _cell(i: int, c: ColumnSchema, spans: bool) -> str:
    """A column's value from ``_s``."""
    if c.type is LogicalType.NULL:
        return "cast(null as string)"
    if c.type is not LogicalType.STRING:
        return f"_s[{i}].{c.type.value}"
    text = f"_spans[{i}]" if spans else "coalesce(" + ", ".join(f"get_json_object(__line, {_text(p)})" for p in _paths(c.json_path)) + ")"
    nested = f"_s[{i}].list" + (f" or _s[{i}].object" if len(c.json_path.split(".")) >= FLATTEN_DEPTH else "")
    return f"case when {nested} then {text} else _s[{i}].string end"


def _unfit(i: int, c: ColumnSchema) -> str | None:
    """The bit of the type that does not fit, or 0."""
    t = LogicalType
    accepted = {t.INT64: (t.INT64,), t.DOUBLE: (t.INT64, t.DOUBLE), t.BOOL: (t.BOOL,), t.TIMESTAMP: (t.TIMESTAMP,), t.NULL: ()}.get(c.type)
    if accepted is None:
        return None
    mask = ((1 << BITS) - 1) & ~sum(1 << k.code for k in accepted)
    kind = f"_s[{i}].kind"
    if len(c.json_path.split(".")) >= FLATTEN_DEPTH:
        kind = f"(case when _s[{i}].object then {1 << t.STRING.code} else {kind} end)"
    return f"shiftleft(bigint({kind} & {mask}), {BITS * (i % WORD)})"


def extract(lines: DataFrame, schema: InferredSchema, raw_json: str = "compact") -> DataFrame:
    """Adds the schema's columns to ``lines`` along with ``_reason``, ``_misfit`` and ``_repeats``."""
    if schema.duplicate_keys:
        lines = lines.withColumn("__line", _first_keys("__line"))
    cols, tree = schema.columns, _tree(schema)
    fields = _struct(tree) if tree else T.StructType([T.StructField("-", T.StringType())])
    # one projection a step, so that each piece is computed once
    read = lines.select(*MARKS, whole_object(F.col("__line"), fields).alias("_j"))
    times = [(i, c) for i, c in enumerate(cols) if tree and c.type is LogicalType.TIMESTAMP]
    micros = F.struct(F.lit(None).cast("int").alias("-"), *[usual_micros(F.expr(_typed(c))).alias(f"m{i}") for i, c in times])
    read = read.select(*MARKS, "_j", line_reason(F.col("_j"), F.col("__line")).alias("_reason"), micros.alias("_m"))
    doubts = [d for i, c in enumerate(cols) if tree and (d := _doubtful(i, c, raw_json))]
    doubt = " or ".join(["_j.bad is not null", *doubts]) if tree or not cols else "true"
    inner: dict = tree or {}
    for c in () if tree else cols:  # which objects there are is in the paths
        here = inner
        for key in c.json_path.split(".")[:-1]:
            here = here.setdefault(key, {})
    judged = read.selectExpr(*MARKS, "_j", "_m", "_reason", f"_reason is null and ({doubt}) as _doubt", f"case when _reason is null then {_repeats(inner, bool(tree))} else false end as _repeats")
    keep = [*MARKS, "_j", "_m", "_reason", "_doubt", "_repeats"]
    verbatim_spans = raw_json == "verbatim" and bool(cols)
    if verbatim_spans:
        judged = judged.withColumn("_spans", _spans(F.when(F.col("_doubt"), F.col("__line")), F.array(*[F.lit(c.json_path) for c in cols])))
        keep.append("_spans")
    again = F.when(F.col("_doubt"), _by_tags(cols)) if cols else F.lit(None)
    both = judged.select(*keep, again.alias("_s"))
    words = []
    for at in range(0, len(cols), WORD):
        bits = [u for i in range(at, min(at + WORD, len(cols))) if (u := _unfit(i, cols[i]))]
        words.append(" | ".join(bits) or "0L")
    misfit = f"nullif(array({', '.join(words)}), array({', '.join(['0L'] * len(words))}))" if words else "cast(null as array<bigint>)"
    fast = {i: f"timestamp_micros(_m.m{i})" for i, _ in times}
    values = []
    for i, c in enumerate(cols):
        cell = _cell(i, c, verbatim_spans)
        if tree:
            cell = f"case when _doubt then {cell} else {fast.get(i) or _typed(c)} end"
            if c.type is LogicalType.NULL:
                cell = "cast(null as string)"
        values.append(f"case when _reason is null then {cell} end as {_name(c.name)}")
    return both.selectExpr(*MARKS, "_reason", f"case when _doubt then {misfit} end as _misfit", "_repeats", *values)


def misfit_kinds(words: list[int] | None, schema: InferredSchema) -> dict[int, set[LogicalType]]:
    """Types that did not fit, by place of the column."""
    out = {}
    for i in range(len(schema.columns)):
        word = (words or [])[i // WORD] if i // WORD < len(words or []) else 0
        bits = ((word or 0) >> (BITS * (i % WORD))) & ((1 << BITS) - 1)
        if bits:
            out[i] = {k for k in LogicalType if bits >> k.code & 1}
    return out
