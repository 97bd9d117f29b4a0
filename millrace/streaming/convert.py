"""The same extraction over files that keep arriving, with the schema pinned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.convert import _only, settings
from ..operators.extract import extract
from ..plans.config import MAX_LINE_BYTES, InferredSchema
from ..sources.lines import _clean


def stream_rows(spark: SparkSession, folder: str, schema: InferredSchema) -> DataFrame:
    """A streaming DataFrame of typed rows; bad lines and misfits are left out.
    Stateless, so there is nothing to watermark. Of repeated keys the last counts,
    unless the schema was inferred from lines that have some."""
    raw = spark.readStream.option("lineSep", "\n").text(folder)
    value = _clean(F.col("value"), MAX_LINE_BYTES).alias("__line")
    lines = raw.select(F.lit(0).alias("__src"), F.lit("").alias("__block"), F.lit(0).cast("bigint").alias("__seq"), value).filter("__line <> ''")
    rows = extract(lines, schema)
    return _only(rows, F.col("_reason").isNull() & F.col("_misfit").isNull(), [c.name for c in schema.columns])


def stream_to_parquet(spark: SparkSession, folder: str, schema: InferredSchema, out: str, checkpoint: str) -> StreamingQuery:
    """Converts what is there and stops; run again for what came since."""
    with settings(spark):
        rows = stream_rows(spark, folder, schema)
        return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
