"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash. A document finishes at the
virtual time ``(size of its source up to and with it) / weight``; a second
pass over a source finishes later by the whole source. Read in the order of
finish times, sources progress by their weights, so cutting that order at the
total budget gives every source its share, and one that has run out of passes
leaves the rest to the others. Only DataFrame functions are used.

Nulls: a null text has size 0, a null source is a source, a null doc_id an id.
Documents of size 0 are in the result with nothing taken. Repeated rows are counted
first and then queue as documents of their own, so that reruns agree on how many
of them are taken; documents that finish together are taken together. A long text
is one document, whole or not at all. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.order import with_position
from .common import buckets_for, cut, number_within, stored, table, uniform

WORDS = r"[^\x20\x09-\x0D]+"
#: Rows of the finish-time order that one task sorts at the cut.
EXACT_ROWS = 100_000
RANGES = 4096
#: Documents that are broadcast to the stage that repeats them.
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Weights repeat over the sources in code point order, null last."""
    placed = with_position(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return placed.withColumn("weight", F.element_at(cycle, (F.col("_place") % len(weights) + 1).cast("int"))).drop("_null", "_place")


def water_level(sources: DataFrame, budget: float, passes: float) -> float:
    """The level at which sum(min(passes * size, level * weight)) is the budget:
    sources below it are full, and what they leave raises it for the others."""
    cap = F.col("source_size") * passes
    level = 0.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(full, cap)).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            return level
        new = (budget - (row["cap"] or 0.0)) / row["weight"]
        if new <= level * (1 + 1e-12):
            return max(level, new)
        level = new


def _cut_time(items: DataFrame, budget: float, top: float) -> float:
    """The last finish time up to which sizes add up to no more than the budget."""
    low, high, before = 0.0, math.nextafter(top, math.inf), 0
    while True:
        here = items.filter((F.col("time") >= low) & (F.col("time") < high))
        place = F.least(F.floor((F.col("time") - low) / (high - low) * RANGES), F.lit(RANGES - 1))
        hist = here.groupBy(place.alias("at")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last")).orderBy("at").collect()
        chosen = None
        for row in hist:  # at most RANGES rows
            if before + row["size"] > budget:
                chosen = row
                break
            before += row["size"]
        if chosen is None:
            return top
        low, high = chosen["first"], math.nextafter(chosen["last"], math.inf)
        if chosen["n"] <= EXACT_ROWS or chosen["first"] == chosen["last"]:
            break
    if chosen["first"] == chosen["last"]:
        return math.nextafter(low, -math.inf)
    exact = items.filter((F.col("time") >= low) & (F.col("time") < high)).groupBy("time").agg(F.sum("size").alias("size"))
    running = exact.withColumn("total", F.sum("size").over(Window.orderBy("time")))
    last = running.filter(F.col("total") + before <= budget).agg(F.max("time")).first()[0]
    return math.nextafter(low, -math.inf) if last is None else last


def mix_sources(docs: DataFrame, weigh=cyclic_weights, share: float = 1.5, passes: int = 2, seed: int = 17, keep_tie: bool = False) -> DataFrame:
    """``docs``: doc_id, source, size, tie (any value that tells equal ids apart).

    ``weigh`` adds a positive column ``weight`` to (source, source_size).
    The budget is ``share`` of all sizes; a source is read ``passes`` times at
    most. Returns doc_id, size, source, source_size, weight, target, taken."""
    extra = ["tie"] if keep_tie else []
    # equal rows are told apart by a number, so that they queue at places of their own
    equal = docs.groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("rows"))
    each = equal.withColumn("which", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    rows = cut(each.select("doc_id", "source", "size", *extra, uniform(F.lit(seed), "doc_id", "tie", "which").alias("place")))
    sources = cut(weigh(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))))
    total = sources.agg(F.sum("source_size").alias("size"), F.sum("n").alias("n")).first()
    size, n = total["size"] or 0, total["n"] or 0
    budget = size * share
    level = water_level(sources, budget, passes)
    parts = buckets_for(n, least=256)
    # running size within a source: by range of the shuffle, then within the range
    ranged = rows.withColumn("range", F.floor(F.col("place") * parts))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"))
    inner = Window.partitionBy("source", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("inner", F.sum("size").over(inner))
    met = summed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    known = sources.select(F.col("source").alias("k"), "source_size", "weight")
    queued = met.join(known, F.col("source").eqNullSafe(F.col("k"))).select(*extra, "doc_id", "source", "size", "source_size", "weight", (F.col("start") + F.col("inner")).alias("upto"))
    queued = cut(queued)
    times = [(F.col("upto") + F.col("source_size") * i) / F.col("weight") for i in range(passes)]
    items = queued.filter("size > 0").select("size", F.explode(F.array(*times)).alias("time"))
    top = sources.agg(F.max(F.col("source_size") * passes / F.col("weight"))).first()[0] or 0.0
    last = _cut_time(items, budget, top) if size else 0.0
    taken = sum((F.when(t <= last, F.col("size")).otherwise(0) for t in times), F.lit(0))
    target = F.least(F.col("source_size") * float(passes), F.lit(level) * F.col("weight"))
    return queued.select(*extra, "doc_id", "size", "source", "source_size", "weight", target.cast("double").alias("target"), taken.cast("long").alias("taken"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """What ``mix_sources`` reads of documents."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text", "source").alias("tie"))


def mixed_documents(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The rows of ``docs``, all columns, once for each time the mix takes them.

    Rows that share id, text and source are as good as each other: what is taken
    of them goes round them."""
    taken = mix_sources(sized_documents(docs), keep_tie=True, **options).filter("size > 0")
    times = taken.groupBy("doc_id", "tie").agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0")
    times = cut(times.select(F.col("doc_id").alias("id"), "tie", "rows", F.expr("copies div rows").alias("all"), (F.col("copies") % F.col("rows")).alias("some")))
    # ids and counts alone; they are broadcast only up to a fixed number, and joined by a shuffle beyond it
    side = F.broadcast(times) if times.count() <= broadcast_rows else times
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = whole.select("row", F.col("row.doc_id").alias("_doc"), F.xxhash64("row.text", "row.source").alias("_key"))
    met = keyed.join(side, F.col("_doc").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("tie"))).drop("_doc", "_key")
    out = met.filter("some = 0").select("row", "all")
    if not times.filter("some > 0 and rows > 1").isEmpty():
        odd = stored(met.filter("some > 0").withColumn("at", uniform(F.lit(5), F.monotonically_increasing_id())))
        numbered = number_within(odd, ["id", "tie"], F.col("at"), 64, "n", ["at"])
        out = out.unionByName(numbered.select("row", (F.col("all") + F.when(F.col("n") < F.col("some"), 1).otherwise(0)).alias("all")))
    again = out.filter(F.col("all") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("all"))).alias("again"))
    return again.select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(sized_documents(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "weight")
