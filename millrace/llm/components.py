"""Connected components by contraction, for edges of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _follow(df: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """``column`` replaced by its parent where it has one."""
    p = parent.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
    out = df.join(p, df[column] == F.col("_u"), "left")
    return out.withColumn(column, F.coalesce("_p", column)).drop("_u", "_p")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of bigints. Returns (node, root): the smallest node
    reachable, for every node that is not the smallest itself.

    Each node points to its smallest smaller neighbour; pointers are followed to
    their ends; edges are redrawn between the ends. A round at least halves the
    nodes that still have edges. Nothing but counts reaches the driver."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    found = None
    while not e.isEmpty():
        parent = cut(e.groupBy("u").agg(F.min("v").alias("p")))
        while True:
            up = parent.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
            jumped = cut(parent.join(up, parent["p"] == F.col("_u"), "left").select("u", F.coalesce("_p", "p").alias("p"), F.col("_p").isNotNull().alias("moved")))
            parent = jumped.select("u", "p")
            if jumped.filter("moved").isEmpty():
                break
        here = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        found = here if found is None else cut(_follow(found, "root", parent).unionByName(here))
        e = cut(_follow(_follow(e, "u", parent), "v", parent).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    if found is None:
        return edges.select(F.col("a").cast("bigint").alias("node"), F.col("b").cast("bigint").alias("root")).limit(0)
    return found
