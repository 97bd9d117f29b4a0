"""Embedding near-duplicates: an exact join by strips and sketches.

Vectors are scaled to length one, so that a cosine is a product. Equal vectors of a
label are one class, and a class is stored once, as the table has it. Labels of up to
``BLOCK_ROWS`` classes are brought together and compared. Of a larger one, a strip at a
time is told to every task, which holds its stored rows against it: no vector is
copied on disk, however large its label. Classes are ordered by hash, and each pair
meets where the greater of the two is in the strip.

A sketch holds a vector's components along a few axes, and the length of what they
leave. By the inequality of Cauchy and Schwarz the product of two sketches, lengths
included, is no less than the vectors' own; only pairs whose sketches reach the
threshold are compared in double precision, as parts of a matrix product. Any axes give
the same pairs; the strip's main ones leave few. Tasks return counts and one link a vector.

Vectors that are null, zero, or hold null or non-finite components, and those without a
label, link with nothing. A vector links only with vectors of the same number of
components. Repeated rows are vectors of their own, and rows that share a vec_id are
told apart by their vectors; a null vec_id is an id. A cosine of the threshold itself is
a link. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import scratch
from .blocks import each_group, matrix, smallest_reachable
from .common import small_batches, stored, table
from .components import components

THRESHOLD = 0.98
#: Classes of a label that are compared without strips.
BLOCK_ROWS = 2048
#: Classes and bytes of a strip at most, and rows and columns that are compared at once.
CELL, CELL_BYTES, STRIP = 1 << 16, 1 << 24, 512
#: Axes of a sketch at most, vectors that they are made of, and what single precision may be off.
MOST_PIVOTS, AXES_OF, SLACK = 15, 4096, 1e-5
NO_ID = -(2**63)
KEY = ["label", "dim", "k1", "k2"]
LINKS = "id bigint, links bigint, hub bigint"


def read_vectors(vectors: DataFrame) -> DataFrame:
    """(id, label, dim, vec binary, k1, k2) of every row; vec is null where it can't link."""
    names = ["id", "label", "dim", "vec", "k1", "k2"]
    kind = _kind(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values
            gone = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
            x = values.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            size = np.diff(at)
            ok = lists.is_valid().to_numpy(zero_copy_only=False) & b.column(2).is_valid().to_numpy(zero_copy_only=False) & (size > 0) & (gone[at[1:]] == gone[at[:-1]])
            raw = np.full(b.num_rows, None, object)
            for d in np.unique(size[ok]):  # vectors of one length at a time
                rows = np.flatnonzero(ok & (size == d))
                m = x[at[rows][:, None] + np.arange(d)]
                usable = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
                raw[rows[usable]] = [r.tobytes() for r in m[usable]]
            columns = [b.column(0), b.column(2).cast(pa.int64()), pa.array(size), pa.array(raw, pa.binary()), b.column(3), b.column(4)]
            yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(vectors.sparkSession)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("embedding"), F.col("label").cast("bigint").alias("label"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(7), "embedding").alias("k2"))
    return rows.mapInArrow(run, "id bigint, label bigint, dim bigint, vec binary, k1 bigint, k2 bigint")


def _kind(vectors: DataFrame) -> str:
    """How a component is stored: as the table has it."""
    kind = vectors.schema["embedding"].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def to_units(raw: pa.Array, kind: str) -> np.ndarray:
    m = matrix(raw, kind).astype(np.float64)
    m /= np.abs(m).max(axis=1)[:, None]
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    return m


def main_axes(units: np.ndarray, most: int) -> np.ndarray:
    """Orthonormal columns along which vectors differ most."""
    some = units[:: -(-len(units) // AXES_OF)]
    some = some - some.mean(axis=0)
    return np.linalg.eigh(some.T @ some)[1][:, ::-1][:, :most]


def sketch(units: np.ndarray, axes: np.ndarray) -> np.ndarray:
    along = units @ axes
    # never shorter than what is left: rounding would matter near zero only
    left = np.sqrt(((units - along @ axes.T) ** 2).sum(axis=1))
    return np.concatenate([along, left[:, None]], axis=1).astype(np.float32)


class Part:
    """Classes of one (label, dim), in the order of (k1, k2)."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, kind: str) -> None:
        k1, k2 = (np.asarray(rows.column(c)) for c in ("k1", "k2"))
        at = np.lexsort((k2, k1))
        self.k1, self.k2 = k1[at], k2[at]
        self.ids, self.copies = (np.asarray(rows.column(c))[at] for c in ("id", "copies"))
        self.units = to_units(rows.column("vec").take(pa.array(at)), kind)


class Strip:
    """A part that others are held against; counts and joins what links with it."""

    def __init__(self, part: Part, axes: np.ndarray | None, threshold: float, tile: int) -> None:
        self.part, self.axes, self.threshold, self.tile = part, axes, threshold, tile
        self.sketch = None if axes is None else np.ascontiguousarray(sketch(part.units, axes).T)
        self.links, self.label = np.zeros(len(part.ids), np.int64), np.arange(len(part.ids))

    def _tile(self, rows: Part, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        linked = rows.units[i] @ self.part.units[j].T >= self.threshold
        a, b = rows.k1[i][:, None], self.part.k1[j][None, :]
        return linked & ((b > a) | (b == a) & (self.part.k2[j][None, :] > rows.k2[i][:, None]))

    def meet(self, rows: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, links, hub) of the rows that link with a greater class of the strip."""
        n, size = len(rows.ids), len(self.label)
        links, edges = np.zeros(n, np.int64), []
        first = None if self.axes is None else sketch(rows.units, self.axes)
        for r in range(0, n, self.tile):
            here = np.arange(r, min(r + self.tile, n))
            for c in range(int(np.searchsorted(self.part.k1, rows.k1[r])), size, self.tile):
                i, j = here, np.arange(c, min(c + self.tile, size))
                if first is not None:
                    near = first[r : r + self.tile] @ self.sketch[:, c : c + self.tile] >= self.threshold - SLACK
                    if not near.any():
                        continue
                    i, j = i[near.any(axis=1)], j[near.any(axis=0)]
                linked = self._tile(rows, i, j)
                if not linked.any():
                    continue
                links[i] += linked @ self.part.copies[j]
                self.links[j] += rows.copies[i] @ linked
                # a tile of many links leaves no more of them than it has rows and columns
                a, b = np.nonzero(linked)
                least, node = smallest_reachable(len(j) + len(i), a + len(j), b), np.concatenate([j, size + i])
                own = np.flatnonzero(least != np.arange(len(node)))
                edges.append((node[own], node[least[own]]))
        some = np.flatnonzero(links)
        if len(some):
            a, b = (np.concatenate(e) for e in zip(*edges, strict=True))
            label = smallest_reachable(size + n, a, b, np.concatenate([self.label, size + np.arange(n)]))
            self.label = label[:size]
            return rows.ids[some], links[some], self.part.ids[label[size + some]]
        return rows.ids[:0], links[:0], rows.ids[:0]

    def end(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, links, hub) of the strip's own classes."""
        some = np.flatnonzero(self.links)
        return self.part.ids[some], self.links[some], self.part.ids[self.label[some]]


def _batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["id", "links", "hub"])


def _spans(b: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Rows of each (label, dim) of a batch."""
    keys, which = np.unique(np.stack([b.column("label").to_numpy(), b.column("dim").to_numpy()], axis=1), axis=0, return_inverse=True)
    for k, (a, d) in enumerate(keys):
        yield (int(a), int(d)), b.take(pa.array(np.flatnonzero(which.ravel() == k)))


def join_small(classes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(id, links, hub) within labels of few classes, each brought together."""
    tile = STRIP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, starts in each_group(batches, ["label", "dim"]):
            found = []
            for start, end in zip(starts, np.append(starts[1:], whole.num_rows), strict=True):
                if end - start > 1:
                    part = Part(whole.slice(start, end - start), kind)
                    strip = Strip(part, None, threshold, tile)
                    found += [strip.meet(part), strip.end()]
            yield _batch(found)

    return classes.repartition("label", "dim").sortWithinPartitions("label", "dim").mapInArrow(run, LINKS)


def cut_strips(large: list, width: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Strips as lists of (label, dim, lowest k1, highest k1)."""
    strip, room = [], 1.0
    for label, dim, n in large:
        slices = -(-n // max(1, min(CELL, CELL_BYTES // (dim * width))))
        share = n / slices / max(1, min(CELL, CELL_BYTES // (dim * width)))
        for s in range(slices):
            if strip and share > room:
                yield strip
                strip, room = [], 1.0
            low, high = ((1 << 64) * x // slices - (1 << 63) for x in (s, s + 1))
            strip.append((label, dim, low, high - 1))
            room -= share
    if strip:
        yield strip


def _among(strip: list[tuple[int, int, int, int]], from_lowest: bool) -> Column:
    """Rows of a strip, or those that it is to meet."""
    some = [(F.col("label") == label) & (F.col("dim") == dim) & (F.col("k1") <= high) & (F.lit(True) if from_lowest else F.col("k1") >= low) for label, dim, low, high in strip]
    while len(some) > 1:  # a shallow tree
        some = [a | b for a, b in zip(some[::2], some[1::2], strict=False)] + some[len(some) // 2 * 2 :]
    return some[0]


def join_strip(classes: DataFrame, strip: list[tuple[int, int, int, int]], kind: str, threshold: float, path: str) -> None:
    """Appends (id, links, hub) of a strip against the classes before it and its own."""
    spark, tile, most = classes.sparkSession, STRIP, MOST_PIVOTS
    held = []
    for b in classes.filter(_among(strip, False)).toArrow().combine_chunks().to_batches():
        for key, rows in _spans(b):
            held.append((key, rows, main_axes(to_units(rows.column("vec"), kind), most)))
    if not held:
        return
    told = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips: dict[tuple[int, int], list[Strip]] = {}
        for b in batches:
            found = []
            for key, rows in _spans(b):
                if key not in strips:
                    strips[key] = [Strip(Part(r, kind), axes, threshold, tile) for k, r, axes in told.value if k == key]
                part = Part(rows, kind)
                found += [s.meet(part) for s in strips[key]]
            yield _batch(found)
        yield _batch([s.end() for each in strips.values() for s in each])

    classes.filter(_among(strip, True)).mapInArrow(run, LINKS).write.mode("append").parquet(path)
    told.destroy()


def find_links(classes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(id, links, hub) of classes (id, label, dim, k1, k2, copies, vec)."""
    spark, path = classes.sparkSession, scratch(classes.sparkSession, "links")
    # fewer than one for every BLOCK_ROWS classes
    large = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_ROWS).orderBy("label", "dim").collect()
    known = spark.createDataFrame([(r["label"], r["dim"]) for r in large], "label bigint, dim bigint")
    join_small(classes.join(F.broadcast(known), ["label", "dim"], "left_anti"), kind, threshold).write.parquet(path)
    for strip in cut_strips(large, np.dtype(kind).itemsize):
        join_strip(classes, strip, kind, threshold, path)
    return spark.read.schema(LINKS).parquet(path)


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    read = read_vectors(vectors)
    rows = stored(read.select("id", *KEY, F.col("vec").isNotNull().alias("ok")))
    grouped = read.filter("vec is not null").groupBy(*KEY).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    classes = stored(grouped.sortWithinPartitions(*KEY))
    # classes of two labels may share an id if rows do: number them by a hash of the key instead
    node = F.xxhash64("id", *KEY)
    shared = classes.count() != classes.select("id").distinct().count()
    named = classes.withColumn("node", node if shared else F.col("id"))
    linked = find_links(named.select(*KEY, F.col("node").alias("id"), "copies", "vec"), _kind(vectors), threshold)
    links = linked.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "node")
    found = components(linked.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    told = named.drop("vec").join(links, "node", "left").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if shared:
        least = told.groupBy("root").agg(F.min("id").alias("least"))
        told = told.join(least, "root").withColumn("root", F.col("least"))
    told = stored(told.select(*KEY, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("root").alias("component_id")))
    linkable = rows.filter("ok").join(told, KEY).select("id", "n_links", "component_id")
    rest = rows.filter("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linkable.unionByName(rest)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("id").alias("vec_id"), "n_links", real("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))
