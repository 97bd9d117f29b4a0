"""What several operators share: reading tables, cutting lineage, groups that spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import cut, stored

__all__ = ["ARROW_ROWS", "buckets_for", "cut", "is_among", "looked_up", "number_within", "small_batches", "stored", "table", "uniform"]

#: What share of the rows a key must have to be treated apart: 1 / HOT.
HOT = 1024
#: Rows of one Arrow batch: long texts must fit a worker's memory.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most ARROW_ROWS rows at once."""
    now = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
    if now is None or int(now) <= 0 or int(now) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def uniform(*cols) -> Column:
    """A place in [0, 1) that depends on the given columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def buckets_for(rows: int, each: int = 20_000, least: int = 16) -> int:
    """How many even parts of about ``each`` rows."""
    return max(least, -(-rows // each))


def number_within(df: DataFrame, group: list[str], place: Column, parts: int, name: str, order: list[str]) -> DataFrame:
    """Numbers rows from 0 within each group, in the order of ``place`` (in
    [0, 1)) and ``order``. A group of any size is spread over ``parts`` ranges of
    ``place``; only counts by group and range meet."""
    df = df.withColumn("_place", place).withColumn("_range", F.floor(F.col("_place") * parts))
    counts = df.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*group, "_range").orderBy("_place", *order)
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in (*group, "_range")]
    rows = df.withColumn("_rank", F.row_number().over(inner) - 1)
    keys = same[0]
    for s in same[1:]:
        keys = keys & s
    out = rows.alias("_l").join(starts.alias("_r"), keys)
    return out.select(*[F.col(f"_l.`{c}`") for c in df.columns if c not in ("_place", "_range")], (F.col("_start") + F.col("_rank")).cast("long").alias(name))


def looked_up(rows: DataFrame, keys: list[str], told: DataFrame, what: list[str], spread: list[str]) -> DataFrame:
    """``rows`` with the columns ``what`` of ``told`` (keys, ``n``: how many rows have
    them, stored), null where a key is not in it.

    Keys of more than 1 / HOT of those rows, fewer than HOT, are told to every task, and their rows
    travel under a number made of ``spread``, so that none of them fill one task."""
    total = told.agg(F.sum("n")).first()[0] or 0
    hot = told.filter(F.col("n") * HOT > total).select(*keys, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in what])
    rest = told.filter(F.col("n") * HOT <= total).select(*keys, F.lit(0).alias("_salt"), *[F.col(c).alias(f"_r_{c}") for c in what])
    apart = F.col("_hot").isNotNull()
    for k in keys:  # rows without a key match nothing, and need not meet either
        apart = apart | F.col(k).isNull()
    salt = F.when(apart, F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int") + 1).otherwise(0)
    met = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(rest, [*keys, "_salt"], "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(f"_h_{c}", f"_r_{c}").alias(c) for c in what])


def is_among(rows: DataFrame, keys: list[str], counts: DataFrame, name: str, spread: list[str]) -> DataFrame:
    """``rows`` with a boolean ``name``: whether their keys are in ``counts``."""
    met = looked_up(rows, keys, counts.withColumn(name, F.lit(True)), [name], spread)
    return met.withColumn(name, F.coalesce(name, F.lit(False)))
