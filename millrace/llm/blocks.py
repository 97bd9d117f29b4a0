"""Groups of any size in blocks of bounded size, processed as Arrow streams.

A group of more than ``most`` rows is cut into parts by hash, and each pair of
parts meets in a block of its own, so that every pair of rows meets somewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deal_blocks(df: DataFrame, keys: list[str], size: Column, item: Column, most: int) -> DataFrame:
    """Adds lo, hi (a block's two parts) and part; rows are copied to each block
    they belong to, then brought together and sorted by block.

    ``size`` is the number of rows of the row's group."""
    parts = F.ceil(size / most).cast("int")
    df = df.withColumn("part", F.pmod(F.xxhash64(item), parts).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), parts - 1)))
    df = df.withColumn("lo", F.least("part", "_with")).withColumn("hi", F.greatest("part", "_with")).drop("_with")
    return df.repartition(*keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi")


def each_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of a sorted stream, many at a time: rows, and group offsets.
    A row is copied once, however many batches its group takes."""

    def last_key(b: pa.RecordBatch) -> tuple:
        return tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)

    def first_key(b: pa.RecordBatch) -> tuple:
        return tuple(b.column(k)[0].as_py() for k in keys)

    def starts(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        one = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return one, starts(one)

    held: list[pa.RecordBatch] = []  # the stream's last group so far
    for b in batches:
        if not b.num_rows:
            continue
        at = int(starts(b)[-1])
        if held and not at and last_key(held[-1]) == first_key(b):
            held.append(b)
            continue
        done = [*held, b.slice(0, at)] if at else held
        if done:
            yield whole(done)
        held = [b.slice(at)]
    if held:
        yield whole(held)


def matrix(raw: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.combine_chunks()
    if not len(raw):
        return np.zeros((0, 0), kind)
    _, offsets, data = raw.buffers()
    wide = pa.types.is_large_binary(raw.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(raw), -1)


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n rows the smallest row that links a-b lead to, on top of what ``label`` holds already."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    return label


def pairs_of(sizes: np.ndarray, starts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups of 2 to ``most`` rows, size by size."""
    for s in np.unique(sizes[(sizes > 1) & (sizes <= most)]):
        i, j = np.triu_indices(int(s), 1)
        at = starts[sizes == s]
        step = max(1, 2_000_000 // len(i))
        for k in range(0, len(at), step):
            base = at[k : k + step, None]
            yield (base + i).ravel(), (base + j).ravel()

