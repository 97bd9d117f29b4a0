"""Sharding by a k-d tree over metadata.

The tree starts with all rows and a number of shards. A node with n shards
gives n // 2 of them to its lower side: it is cut at the point of its widest
dimension up to which that share of its bytes lies (a weighted median). Leaves
are shards of nearly equal bytes.

Points are documents under the metadata of the first document of their group
of equal texts. Ties of a dimension are ordered by a hash of the group and then by
one of the document, so a group lies together in that order, and only a group that a
cut falls into is divided: at most one for each cut, so shards - 1 of them,
whatever their sizes. A cut is exact to a thousandth of a shard's bytes, and
a group of less than that is never divided.

Histograms of bytes find the cuts: at most ``shards`` x BINS rows reach the
driver in a round, whatever the table's size, and every row counts.

Nulls: a null text has no bytes and the checksum of an empty text, but is a
group of its own; null metadata is a value; a null doc_id is an id. Repeated rows are
rows of their own, so a shard may hold any number of them. A text of any length
is one row and in one shard, which may so exceed the others. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, number_within, stored, table, uniform

ROW_BYTES = 16
BINS = 1024
#: Groups with more than 1 / WIDE of all rows are told to every task; there are fewer than WIDE.
WIDE = 1024


def position(value: Column, kind: str) -> Column:
    """Metadata as a number: numbers by size, everything else by a hash in [0, 1)."""
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        x = F.coalesce(value.cast("double"), F.lit(0.0))
        # far tails would make every other dimension look narrow
        return F.signum(x) * F.log1p(F.abs(F.when(F.isnan(x), 0.0).otherwise(x)))
    return uniform(F.lit(1), F.coalesce(value.cast("string"), F.lit("\0")))


class _Node:
    def __init__(self, name: int, first: int, shards: int):
        self.name, self.first, self.shards = name, first, shards
        self.dim, self.low, self.high, self.before = 0, 0.0, 0.0, 0.0
        self.cut: list[float] = []
        self.goal, self.weight = 0.0, 0.0


def _with_nodes(rows: DataFrame, nodes: list[_Node], **told) -> DataFrame:
    """Rows of the given nodes, with a column for what is told of each; there are fewer nodes than shards."""
    data = [(n.name, *[float(f(n)) for f in told.values()]) for n in nodes]
    known = rows.sparkSession.createDataFrame(data, "node int, " + ", ".join(f"{k} double" for k in told))
    return rows.join(F.broadcast(known), "node")


def _histogram(rows: DataFrame, nodes: list[_Node], value: str) -> dict[int, list]:
    """Per node, bins of ``value`` in [low, high]: (bin, bytes, least, greatest)."""
    low, high, v = F.col("_low"), F.col("_high"), F.col(value)
    at = F.when(high > low, F.least(F.floor((v - low) / (high - low) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
    inside = _with_nodes(rows, nodes, _low=lambda n: n.low, _high=lambda n: n.high).filter((v >= low) & (v <= high))
    out: dict[int, list] = {}
    for r in inside.groupBy("node", at.alias("bin")).agg(F.sum("weight").alias("w"), F.min(v).alias("least"), F.max(v).alias("most")).orderBy("node", "bin").collect():
        out.setdefault(r["node"], []).append(r)
    return out


def _narrow(rows: DataFrame, nodes: list[_Node], value: str, exact: float = 0.0) -> None:
    """Shrinks each node's [low, high] to the one value at which its goal is reached,
    or, with ``exact``, to a range of at most that many bytes."""
    left = list(nodes)
    while left:
        hist = _histogram(rows, left, value)
        rest = []
        for n in left:
            bins = hist.get(n.name, [])
            n.weight = 0.0
            for r in bins:
                n.weight = r["w"]
                if n.before + r["w"] >= n.goal or r is bins[-1]:
                    n.low, n.high = r["least"], r["most"]
                    break
                n.before += r["w"]
            if n.low < n.high and n.weight > exact and bins:
                rest.append(n)
        left = rest


def _below(value: Column, cut: list[Column]) -> Column:
    """Whether a point (value, u, w) lies up to a cut."""
    at, u, w = cut
    return (value < at) | ((value == at) & ((F.col("u") < u) | ((F.col("u") == u) & (F.col("w") <= w))))


def _place(splits: dict[int, _Node], leaf: Callable[[int, int, int], Column], shards: int) -> Column:
    """What ``leaf`` says of the node that a point falls into: (name, first shard, shards)."""

    def descend(name: int, first: int, count: int) -> Column:
        n = splits.get(name)
        if n is None:
            return leaf(name, first, count)
        half = count // 2
        lower = _below(F.col(f"x{n.dim}"), [F.lit(c) for c in n.cut])
        return F.when(lower, descend(2 * name, first, half)).otherwise(descend(2 * name + 1, first + half, count - half))

    return descend(1, 0, shards)


def _once(value: Column) -> Column:
    """The same value: the condition always holds, but not to the optimizer, which
    would else copy so long an expression into every use of it."""
    return F.when(F.rand(0) >= 0, value).otherwise(F.lit(0))


def kd_tree(points: DataFrame, dims: int, shards: int) -> Column:
    """The shard of each point, as an expression over its columns x0.., u and w.

    ``points``: x0.., u and w in [0, 1) to order ties, weight. They are read
    again for each histogram, so they should be stored."""
    total = points.agg(F.sum("weight")).first()[0] or 0
    slack = total / max(1, shards) * 1e-3
    nodes = [_Node(1, 0, shards)]
    splits: dict[int, _Node] = {}
    x = [F.col(f"x{i}") for i in range(dims)]
    while nodes := [n for n in nodes if n.shards > 1]:
        rows = points.withColumn("node", _once(_place(splits, lambda name, first, count: F.lit(name), shards)))
        spread = rows.groupBy("node").agg(F.sum("weight").alias("bytes"), *[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(x) for f in (F.min, F.max)])
        known = {r["node"]: r for r in spread.collect()}  # a row a node
        live = [n for n in nodes if n.name in known]
        if not live:
            break
        if not splits:
            scale = [max(r[f"max{i}"] - r[f"min{i}"], 1e-12) for r in known.values() for i in range(dims)]
        for n in live:
            r = known[n.name]
            n.dim = max(range(dims), key=lambda i: (r[f"max{i}"] - r[f"min{i}"]) / scale[i])
            n.low, n.high, n.goal = r[f"min{n.dim}"], r[f"max{n.dim}"], r["bytes"] * (n.shards // 2) / n.shards
        value = reduce(lambda a, i: F.when(F.col("_dim") == i, x[i]).otherwise(a), range(1, dims), x[0])
        rows = _with_nodes(rows, live, _dim=lambda n: n.dim).withColumn("_x", value)
        _narrow(rows, live, "_x")
        # among what ties at the cut the group's hash decides
        for n in live:
            n.cut, n.low, n.high = [n.low], 0.0, 1.0
        rows = _with_nodes(rows, live, _at=lambda n: n.cut[0]).filter(F.col("_x") == F.col("_at"))
        _narrow(rows, live, "u", slack)
        inside = []
        for n in live:
            n.cut.append(n.high)
            if n.low == n.high and n.weight > slack:
                inside.append(n)
            else:
                n.cut.append(1.0)
        if inside:  # cuts that fall into one group
            for n in inside:
                n.low, n.high = 0.0, 1.0
            _narrow(_with_nodes(rows, inside, _u=lambda n: n.cut[1]).filter(F.col("u") == F.col("_u")), inside, "w", slack)
            for n in inside:
                n.cut.append(n.high)
        splits |= {n.name: n for n in live}
        nodes = [c for n in live for c in (_Node(2 * n.name, n.first, n.shards // 2), _Node(2 * n.name + 1, n.first + n.shards // 2, n.shards - n.shards // 2))]
    return _once(_place(splits, lambda name, first, count: F.lit(first), shards))


def kd_shards(docs: DataFrame, shards: int, metadata: tuple[str, ...]) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row.

    ``docs``: doc_id, text and the metadata columns."""
    kinds = dict(docs.dtypes)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # the document's hash, and far behind it one of the row, for rows that repeat an id
    place = F.floor(uniform(F.lit(2), "doc_id") * float(1 << 40)) / float(1 << 40) + uniform(F.lit(3), F.monotonically_increasing_id()) / float(1 << 41)
    rows = stored(docs.select(
        "doc_id", (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("crc"),
        F.xxhash64(F.col("text").isNull(), raw).alias("h1"), F.xxhash64(F.lit(9), raw).alias("h2"), place.alias("w"),
        *[position(F.col(c), kinds[c]).alias(f"x{i}") for i, c in enumerate(metadata)],
    ))
    xs = [f"x{i}" for i in range(len(metadata))]
    n = rows.count()
    groups = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", *xs)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = stored(groups.select("h1", "h2", "n", *[F.col(f"first.{x}").alias(f"g{x}") for x in xs]))
    # the largest groups, fewer than WIDE, are told to all tasks: a join on their keys would have them in one
    wide, several = groups.filter(F.col("n") * WIDE > n).drop("n"), groups.filter(F.col("n") * WIDE <= n).drop("n")
    marked = rows.join(F.broadcast(wide), ["h1", "h2"], "left")
    of_wide = marked.filter(F.col("gx0").isNotNull())
    rest = marked.filter(F.col("gx0").isNull()).drop(*[f"g{x}" for x in xs]).join(several, ["h1", "h2"], "left")
    placed = of_wide.unionByName(rest).select("doc_id", "size", "crc", "w", uniform("h1", "h2").alias("u"), *[F.coalesce(f"g{x}", x).alias(x) for x in xs])
    placed = stored(placed)
    shard = kd_tree(placed.select(*xs, "u", "w", F.col("size").alias("weight")), len(xs), shards)
    told = placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), shard.cast("int").alias("shard"), "w")
    parts = max(16, buckets_for(n) // shards + 1)
    return number_within(told, ["shard"], F.col("w"), parts, "slot", ["doc_id", "text_crc32"]).drop("w")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    out = kd_shards(docs, 40, ("lang", "source", "n_chars"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
