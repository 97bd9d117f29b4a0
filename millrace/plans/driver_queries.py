"""Queries over the driver's tables, each with the SQL that says the same.

A table's rows become JSON lines, go through the conversion, and must come back
as what SQL says of the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import with_position
from ..functions.shared import scratch
from ..operators.convert import collect_errors, convert, infer_schema, settings, to_dataframe
from ..operators.infer import finish, infer_lines
from ..sources.lines import first_lines, lines_from_column
from ..sources.sinks import read_dump
from ..streaming.convert import stream_to_parquet
from .config import ColumnSchema, Config, LogicalType, Projection

_JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "ignoreNullFields": "false"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cfg(**more) -> Config:
    return Config(inputs=("table",), print_schema=True, **more)


def _lines(df: DataFrame, order: Column, value: Column | None = None) -> DataFrame:
    value = F.to_json(F.struct("*"), _JSON) if value is None else value
    return lines_from_column(df.select(value.alias("line"), order.cast("bigint").alias("at")), "line", "at")


def _plain(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the tables have them."""
    with settings(spark):
        return df.select(*[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(f"`{c}`") for c, t in df.dtypes])


def _rows(spark: SparkSession, lines: DataFrame, **more) -> DataFrame:
    return _plain(spark, to_dataframe(spark, _cfg(**more), lines))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events")
    kept = [F.from_json("props", "k bigint").alias(c) if c == "props" else F.col(c) for c in df.columns]
    return _lines(df.select(*kept), F.col("event_id"))


EVENTS = """SELECT event_id, ts, user_id, event_type, value, CAST(props->>'$.k' AS BIGINT) AS "props.k" FROM events"""


@query(EVENTS)
def flatten_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, _events(spark, sf_dir))


# table: (order, columns, columns that come back as BIGINT)
_TRIPS = {
    "nation": ("n_nationkey", "n_nationkey n_name n_regionkey", "n_nationkey n_regionkey"),
    "region": ("r_regionkey", "r_regionkey r_name", "r_regionkey"),
    "customer": ("c_custkey", "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "c_nationkey"),
    "supplier": ("s_suppkey", "s_suppkey s_name s_nationkey s_acctbal", "s_nationkey"),
    "part": ("p_partkey", "p_partkey p_name p_brand p_type p_size p_retailprice", "p_size"),
    "orders": ("o_orderkey", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", ""),
    "lineitem": ("l_orderkey * 10 + l_linenumber", "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "l_linenumber"),
    "documents": ("doc_id", "doc_id text lang source n_chars", ""),
    "conversations": ("conv_id * 1000 + turn", "conv_id turn role text", ""),
    "labels": ("doc_id", "doc_id quality toxic", "quality toxic"),
    "benchmark": ("item_id", "item_id text", ""),
    "pages": ("page_id", "page_id url html", ""),
}


def _trip(name: str, order: str, columns: list[str], wide: set[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(spark, _lines(_table(spark, sf_dir, name).select(*columns), F.expr(order)))

    QUERIES[f"roundtrip_{name}"] = run
    ORACLE_SQL[f"roundtrip_{name}"] = "SELECT " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in wide else c for c in columns) + f" FROM {name}"


for _name, (_order, _columns, _wide) in _TRIPS.items():
    _trip(_name, _order, _columns.split(), set(_wide.split()))


VECTORS = "SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"


def _doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return _lines(vectors, F.col("vec_id"))


def _components(rows: DataFrame, vector: Column) -> DataFrame:
    return rows.select("vec_id", F.posexplode(vector).alias("place", "x")).select("vec_id", (F.col("place") + 1).cast("bigint").alias("place"), "x")


@query(VECTORS)
def embeddings_array_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(_rows(spark, _doubles(spark, sf_dir)), F.from_json("embedding", "array<double>"))


@query("""SELECT event_id, user_id, event_type, value, CAST(props->>'$.k' AS BIGINT) AS props_k, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts FROM events""")
def native_events_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, _events(spark, sf_dir), nested="native")
    return rows.select("event_id", "user_id", "event_type", "value", F.col("props.k").alias("props_k"), "ts")


@query(VECTORS)
def native_embeddings_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(_rows(spark, _doubles(spark, sf_dir), nested="native"), F.col("embedding"))


@query("""SELECT event_id, user_id, event_type, value, CAST(props->>'$.k' AS BIGINT) AS props_k FROM events""")
def native_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'queries')}/native.parquet"
    convert(spark, Config(("table",), output_path=path, nested="native"), _events(spark, sf_dir))
    return spark.read.parquet(path).select("event_id", "user_id", "event_type", "value", F.col("props.k").alias("props_k"))


@query("SELECT value, event_id FROM events")
def project_select_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, _events(spark, sf_dir), projection=Projection(select=("value", "event_id")))


@query("SELECT event_id, user_id, event_type, value FROM events")
def project_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, _events(spark, sf_dir), projection=Projection(exclude=("ts", "props.k", "nothing")))


@query("SELECT event_id AS id, value AS amount FROM events")
def project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Projection(select=("event_id", "value"), rename=(("event_id", "key"), ("value", "amount"), ("key", "id"), ("gone", "x")))
    return _rows(spark, _events(spark, sf_dir), projection=p)


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def project_alias_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias = ColumnSchema("k", LogicalType.INT64, True, "props.k")
    return _rows(spark, _events(spark, sf_dir), schema_override=(alias,), projection=Projection(select=("event_id", "k")))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, printf('%.6f', value) AS value, CAST(user_id % 2 = 0 AS VARCHAR) AS even FROM events")
def override_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") % 2 == 0).alias("even"))
    text = tuple(ColumnSchema(c, LogicalType.STRING) for c in df.columns)
    return _rows(spark, _lines(df, F.col("event_id")), schema_override=text)


def _mixed(spark: SparkSession, sf_dir: str, other: Column) -> DataFrame:
    df = _table(spark, sf_dir, "events").select("event_id")
    i = F.col("event_id").cast("string")
    return _lines(df, F.col("event_id"), F.concat(F.lit('{"id":'), i, F.lit(',"v":'), F.when(F.col("event_id") % 2 == 0, i).otherwise(other), F.lit("}")))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS DOUBLE) ELSE event_id + CAST(0.5 AS DOUBLE) END AS v FROM events")
def widen_int_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, _mixed(spark, sf_dir, F.concat(F.col("event_id").cast("string"), F.lit(".5"))))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'x' || event_id END AS v FROM events")
def widen_int_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, _mixed(spark, sf_dir, F.concat(F.lit('"x'), F.col("event_id").cast("string"), F.lit('"'))))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE event_id || '.500000' END AS v FROM events")
def conflict_policy_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, _mixed(spark, sf_dir, F.concat(F.col("event_id").cast("string"), F.lit(".5"))), type_conflict="string")


@query("SELECT event_id AS id, CAST(NULL AS VARCHAR) AS v FROM events")
def all_null_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("v"))
    return _rows(spark, _lines(df, F.col("id")))


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type FROM events")
def missing_keys_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    df = _table(spark, sf_dir, "events").select(i, F.when(i % 7 != 0, F.col("value")).alias("value"), F.when(i % 5 != 0, F.col("event_type")).alias("event_type"))
    return _rows(spark, _lines(df, i, F.to_json(F.struct("*"))))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events").select("event_id", "value")
    return _lines(df, F.col("event_id"), F.when(F.col("event_id") % 10 == 0, F.lit("broken")).otherwise(F.to_json(F.struct("*"))))


@query("SELECT event_id, value FROM events WHERE event_id % 10 <> 0")
def skip_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, _broken(spark, sf_dir))


@query("SELECT n AS line_no, 'invalid JSON' AS reason, 'broken' AS raw FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE event_id % 10 = 0")
def collect_error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect_errors(spark, _cfg(on_error="collect"), _broken(spark, sf_dir))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate
 WHEN 2 THEN o_orderdate + INTERVAL 123456 MICROSECOND ELSE TIMESTAMP '2026-03-03 10:01:00' END AS t FROM orders""")
def ts_sniff_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    kind, t = F.col("o_orderkey") % 4, F.col("t")
    text = F.when(kind == 0, F.concat(t, F.lit("Z"))).when(kind == 1, F.concat(t, F.lit("+03:00"))).when(kind == 2, F.concat(t, F.lit(".1234567Z"))).otherwise("2026-02-31T10:00:60Z")
    return _rows(spark, _lines(df, F.col("o_orderkey"), F.to_json(F.struct(F.col("o_orderkey").alias("id"), text.alias("t")))))


@query("SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name FROM nation")
def multi_input_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, inputs = scratch(spark, "queries"), []
    for name, key, codec in (("region", "r", None), ("nation", "n", "gzip")):
        df = _table(spark, sf_dir, name).select(F.to_json(F.struct(F.col(f"{key}_{name}key").alias("k"), F.col(f"{key}_name").alias("name"))))
        writer = df.coalesce(1).write
        (writer.option("compression", codec) if codec else writer).text(f"{folder}/{name}")
        inputs.append(f"{folder}/{name}")
    return _plain(spark, to_dataframe(spark, Config(tuple(inputs), print_schema=True)))


def _stored(codec: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{scratch(spark, 'queries')}/events.parquet"
        convert(spark, Config(("table",), output_path=path, compression=codec), _events(spark, sf_dir))
        return _plain(spark, spark.read.parquet(path))

    QUERIES[f"parquet_roundtrip_{codec}"] = run
    ORACLE_SQL[f"parquet_roundtrip_{codec}"] = EVENTS


for _codec in ("zstd", "snappy", "none"):
    _stored(_codec)


def _late(name: str, sql: str, other: Callable[[], Column], **more) -> None:
    """Even rows hold whole numbers, odd ones something else, and the sample ends before any odd one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        i = F.col("event_id")
        text = F.concat(F.lit('{"id":'), i.cast("string"), F.lit(',"v":'), F.when((i % 2 == 0) | (i < 50), i.cast("string")).otherwise(other()), F.lit("}"))
        return _rows(spark, _lines(_table(spark, sf_dir, "events").select("event_id"), i, text), sample_lines=40, **more)

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


_late("late_widen_double", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 OR event_id < 50 THEN CAST(event_id AS DOUBLE) ELSE event_id + CAST(0.5 AS DOUBLE) END AS v FROM events", lambda: F.concat(F.col("event_id").cast("string"), F.lit(".5")))
_late("late_widen_string", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 OR event_id < 50 THEN CAST(event_id AS VARCHAR) ELSE 'true' END AS v FROM events", lambda: F.lit("true"))
_late("late_misfit_rows", "SELECT event_id AS id, event_id AS v FROM events WHERE event_id % 2 = 0 OR event_id < 50", lambda: F.lit("[1]"), threads=2)
_late("late_repeated_keys", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 OR event_id < 50 THEN event_id ELSE 7 END AS v FROM events", lambda: F.lit('7,"id":0,"v":8'))


@query("SELECT event_id AS id, event_id % 3 = 0 AS third, CASE WHEN event_id % 5 <> 0 THEN event_id % 2 = 0 END AS even FROM events")
def bool_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    df = _table(spark, sf_dir, "events").select(i.alias("id"), (i % 3 == 0).alias("third"), F.when(i % 5 != 0, i % 2 == 0).alias("even"))
    return _rows(spark, _lines(df, F.col("id")))


@query("SELECT 'ABORTED' AS state, 'invalid JSON' AS reason, CAST(4 AS BIGINT) AS exit_code")
def abort_on_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = convert(spark, Config(("table",), output_path=f"{scratch(spark, 'queries')}/out.parquet", on_error="abort"), _broken(spark, sf_dir))
    return spark.createDataFrame([(s.final_state.value, s.reason, s.exit_code)], "state string, reason string, exit_code bigint")


@query(EVENTS)
def zstd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a zstd file that Python wrote, read by their suffix."""
    import zstandard

    folder = scratch(spark, "queries")
    packed = F.pandas_udf(lambda parts: parts.map(lambda rows: zstandard.ZstdCompressor().compress("\n".join(rows).encode())), "binary")
    some = _events(spark, sf_dir).groupBy(F.floor(F.col("__seq") / 2500).alias("part")).agg(F.transform(F.sort_array(F.collect_list(F.struct("__seq", "__line"))), lambda r: r["__line"]).alias("rows"))
    inputs = []
    for row in some.select("part", packed("rows").alias("raw")).orderBy("part").toLocalIterator():  # 2,500 lines each
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['part']}.jsonl.zst")
        f = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        f.write(bytearray(row["raw"]))
        f.close()
        inputs.append(path.toString())
    return _plain(spark, to_dataframe(spark, Config(tuple(inputs), print_schema=True)))


@query("SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region")
def glob_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern, and lines of which one is over-long and so cut and bad."""
    folder = scratch(spark, "queries")
    df = _table(spark, sf_dir, "region").select(F.to_json(F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))).alias("value"))
    long = spark.range(1).select(F.concat(F.lit('{"k":1,"name":"'), F.repeat(F.lit("x"), 200), F.lit('"}')).alias("value"))
    df.unionByName(long).write.text(f"{folder}/region")
    return _plain(spark, to_dataframe(spark, Config((f"{folder}/region/part-*",), print_schema=True, max_line_bytes=100)))


@query("SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS place FROM events WHERE event_id % 10 <> 0")
def ordered_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file in the order of the input, whatever the order of the tasks."""
    path = f"{scratch(spark, 'queries')}/one.parquet"
    convert(spark, Config(("table",), output_path=path, single_file=True), _broken(spark, sf_dir).repartition(7))
    rows = spark.read.parquet(path).withColumn("at", F.monotonically_increasing_id())
    numbered = with_position(rows, ["at"], "place")
    return numbered.select("event_id", "value", (F.col("place") + 1).alias("place"))


@query("""SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'event_id', 'int64'), (1, 'ts', 'timestamp'), (2, 'user_id', 'int64'), (3, 'event_type', 'string'),
 (4, 'value', 'double'), (5, 'props.k', 'int64')) AS t(pos, name, type)""")
def inferred_schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infer_schema(spark, _cfg(infer_scope="full"), _events(spark, sf_dir))
    return spark.createDataFrame([(i, c.name, c.type.value) for i, c in enumerate(found.columns)], "pos bigint, name string, type string")


@query("SELECT count(*) FILTER (event_id % 10 <> 0) AS rows_read, count(*) FILTER (event_id % 10 <> 0) AS rows_written, count(*) FILTER (event_id % 10 = 0) AS rows_skipped, 'DONE' AS state FROM events")
def convert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = convert(spark, Config(("table",), output_path=f"{scratch(spark, 'queries')}/out.parquet"), _broken(spark, sf_dir))
    return spark.createDataFrame([(s.rows_read, s.rows_written, s.rows_skipped, s.final_state.value)], "rows_read bigint, rows_written bigint, rows_skipped bigint, state string")


@query("""SELECT event_id AS "a.b.c.x", '{"e":' || event_id || '}' AS "a.b.c.d" FROM events""")
def depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    deep = F.struct(F.struct(F.struct(i.alias("x"), F.struct(i.alias("e")).alias("d")).alias("c")).alias("b")).alias("a")
    return _rows(spark, _lines(_table(spark, sf_dir, "events").select("event_id"), i, F.to_json(F.struct(deep))))


@query(EVENTS)
def raw_dump_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'queries')}/events.dump"
    convert(spark, Config(("table",), output_path=path, output_format="columnar-raw"), _events(spark, sf_dir))
    return _plain(spark, read_dump(spark, path))


@query(EVENTS)
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, lines = scratch(spark, "queries"), _events(spark, sf_dir)
    schema = finish(infer_lines(first_lines(lines, 1000), _cfg()), _cfg())
    lines.select(F.col("__line").alias("value")).write.text(f"{folder}/in")
    stream_to_parquet(spark, f"{folder}/in", schema, f"{folder}/out", f"{folder}/state").awaitTermination()
    return _plain(spark, spark.read.parquet(f"{folder}/out"))
