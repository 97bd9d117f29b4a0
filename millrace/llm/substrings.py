"""Substring deduplication by level-wise doubling.

A window of 35 words repeats only if all shorter windows in it do. Level one
takes 9-word windows: each 35-word window names the one of smallest hash in it
(equal windows name the same one at the same place), so one place in fourteen
is enough. Windows repeated at a length alone go on to twice that length: 18
words to the right and to the left of the named place, then whole stretches (all
35-word windows that name a place, 35 to 61 words), and where a stretch is
unique but its 9-word window is not, the 35-word windows one by one. Every
level is a count by hash; only the last uses 128 bits and decides.

Exact copies of a text need no windows: their words all go, if there are 35 of
them. In each task two copies at most stand for all.

Hashes that very many places share are told to every task and their rows are dealt
by place, so that no task is left with all of one passage.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Nulls: a null text has no words,
a null doc_id is an id. Repeated rows are copies. A text of any length is read
whole, by one task. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, is_among, small_batches, stored, table
from .hashing import Words, inside, mix, rows_of, slices, window_hashes

WINDOW = 35
SEED = 9
TWICE = 2 * SEED
#: Offsets of a named place in its window: 0 to SPAN - 1.
SPAN = WINDOW - SEED + 1
#: Documents whose ids are broadcast to read their texts again; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
NO_ID = -(2**63)
#: A text of a document; t2 beside t1 tells texts of different documents apart.
_KEY = ["id", "t1"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(5), "text").alias("t2"), "text")


def _stretch(prefix_words: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of windows of varying length, by length."""
    out = np.zeros(len(start), np.uint64)
    for n in np.unique(length):
        at = length == n
        out[at] = window_hashes(prefix_words, int(n), seed)[start[at]] + np.uint64(n)
    return out


def named_places(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, least, most): named 9-word windows and the offsets at which
    35-word windows name them."""
    n = len(hashes)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 3
    order = mix(window_hashes(hashes, SEED) ^ np.uint64(0x5851F42D4C957F2D))
    own = np.flatnonzero(inside(words.offsets, WINDOW))
    # smallest of SPAN neighbours by doubling
    low = order.copy()
    at = np.arange(len(order))
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        left, right = low[:-step], low[step:]
        take = right < left
        at = np.where(take, at[step:], at[:-step])
        low = np.where(take, right, left)
        width += step
    place = at[own]
    if not len(place):
        return (np.zeros(0, np.int64),) * 3
    # windows that name one place follow each other
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (own[1:] != own[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    p = place[first]
    return p, p - own[last], p - own[first]


_ANCHOR = ["id", "t1", "place", "least", "most", "seed", "right", "left", "s1", "s2"]
_ANCHOR_DDL = "id bigint, t1 bigint, place int, least int, most int, seed bigint, right bigint, left bigint, s1 bigint, s2 bigint"


def anchors(docs: DataFrame, seeds_only: bool) -> DataFrame:
    """Named places of texts, with the hashes that later levels count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies: dict[tuple[int, int], int] = {}
        for b in slices(batches, 3):
            keep = np.ones(b.num_rows, bool)
            for i, key in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                copies[key] = seen = copies.get(key, 0) + 1
                keep[i] = seen <= 2
            if not keep.all():
                b = b.filter(pa.array(keep))
            if not b.num_rows:
                continue
            words = Words(b.column(3))
            h = words.hashes()
            place, least, most = named_places(words, h)
            seed = pa.array(window_hashes(h, SEED)[place].view(np.int64)) if len(place) else pa.array([], pa.int64())
            if seeds_only:
                yield pa.RecordBatch.from_arrays([seed], ["seed"])
                continue
            row = rows_of(words.offsets)[place]
            begin, end = words.offsets[row], words.offsets[row + 1]
            double = window_hashes(h, TWICE) if len(place) else np.zeros(1, np.uint64)
            n = len(double)
            right, has_right = double[np.minimum(place, n - 1)], place + TWICE <= end
            left, has_left = double[np.maximum(place - SEED, 0).clip(max=n - 1)], place - SEED >= begin
            start, length = place - most, most - least + WINDOW
            h2 = words.hashes(1)
            columns = [*[b.column(c).take(pa.array(row)) for c in range(2)], *[pa.array(x.astype(np.int32)) for x in (place - begin, least, most)], seed]
            columns += [pa.array(right.view(np.int64), mask=~has_right), pa.array(left.view(np.int64), mask=~has_left)]
            columns += [pa.array(_stretch(h, start, length, 0).view(np.int64)), pa.array(_stretch(h2, start, length, 1).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, _ANCHOR)

    small_batches(docs.sparkSession)
    return _keyed(docs).mapInArrow(run, "seed bigint" if seeds_only else _ANCHOR_DDL)


def _repeated(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that occur twice or more, and how often (n)."""
    return stored(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


def windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """35-word windows at given places, hashed to 128 bits: (id, t1, start, open, w1, w2)."""
    lists = wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("place", "least", "most", "open")).alias("at"))
    lists = stored(lists)
    few = lists.count() <= BROADCAST_ROWS
    texts = _keyed(docs)
    if few:  # ids first, so that only the texts needed are moved
        texts = texts.join(F.broadcast(lists.select(*_KEY)), _KEY, "left_semi")
    met = texts.dropDuplicates(_KEY).join(lists, _KEY)
    names = ["id", "t1", "start", "open", "w1", "w2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            words = Words(b.column(2))
            h, h2 = words.hashes(), words.hashes(1)
            w1, w2 = window_hashes(h, WINDOW), window_hashes(h2, WINDOW, 1)
            lists = b.column(3)
            flat = lists.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            place, least, most, is_open = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            count = most - least + 1
            which = np.repeat(np.arange(len(row)), count)
            step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            start = (place - most)[which] + step
            at = words.offsets[row[which]] + start
            back = pa.array(row[which])
            columns = [*[b.column(c).take(back) for c in range(2)], pa.array(start.astype(np.int32)), pa.array(is_open[which]), pa.array(w1[at].view(np.int64)), pa.array(w2[at].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return met.select(*_KEY, "text", "at").mapInArrow(run, "id bigint, t1 bigint, start int, open boolean, w1 bigint, w2 bigint")


def repeats(docs: DataFrame) -> DataFrame:
    """(id, t1, first, last): runs of starts of repeated windows."""
    often = _repeated(anchors(docs, True), "seed")
    place = [*_KEY, "place"]
    level1 = is_among(anchors(docs, False), ["seed"], often, "again", place).filter("again")
    level1 = stored(level1.select(*_ANCHOR))
    sides = level1.select(F.lit(0).alias("side"), F.col("right").alias("h")).unionByName(level1.select(F.lit(1).alias("side"), F.col("left").alias("h"))).filter("h is not null")
    twice = _repeated(sides, "side", "h")
    level2 = is_among(level1, ["right"], twice.filter("side = 0").select(F.col("h").alias("right"), "n"), "r", place)
    level2 = is_among(level2, ["left"], twice.filter("side = 1").select(F.col("h").alias("left"), "n"), "l", place)
    # windows at offsets up to 17 hold the right side, those from 9 on the left side
    level2 = level2.withColumn("from", F.when(F.col("r"), F.col("least")).otherwise(F.greatest("least", F.lit(TWICE))))
    level2 = level2.withColumn("to", F.when(F.col("l"), F.col("most")).otherwise(F.least("most", F.lit(SEED - 1)))).filter(F.col("from") <= F.col("to"))
    level2 = stored(level2.select(*_KEY, "place", "least", "most", "from", "to", "seed", "s1", "s2"))
    # whole stretches
    first = F.min(F.struct(*_KEY, "place", "least", "most")).alias("first")
    classes = stored(level2.groupBy("seed", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), first))
    met = is_among(level2, ["seed", "s1", "s2"], classes.filter("n > 1").select("seed", "s1", "s2", "n"), "again", place)
    whole = met.filter("again").select(*_KEY, (F.col("place") - F.col("most")).alias("first"), (F.col("place") - F.col("least")).alias("last"))
    single = met.filter("not again").select(*_KEY, "place", F.col("from").alias("least"), F.col("to").alias("most"), F.lit(True).alias("open"))
    # a unique stretch may share windows with a repeated one of the same seed
    seeds = stored(classes.filter("n = 1").groupBy("seed").agg(F.count(F.lit(1)).alias("n")))
    partners = is_among(classes.filter("n > 1").select("seed", "first"), ["seed"], seeds, "needed", ["first"])
    partners = partners.filter("needed").select("first.*").withColumn("open", F.lit(False))
    rows = stored(windows(docs, single.unionByName(partners)))
    ones = is_among(rows.filter("open"), ["w1", "w2"], _repeated(rows, "w1", "w2"), "again", [*_KEY, "start"])
    ones = ones.filter("again").select(*_KEY, F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.unionByName(ones)


def copied(docs: DataFrame) -> DataFrame:
    """(id, t1, n) of texts that stand in several rows, for each id that they stand under n times."""
    keyed = _keyed(docs).filter("text is not null").groupBy(*_KEY, "t2").agg(F.count(F.lit(1)).alias("n"))
    keyed = stored(keyed)
    several = stored(keyed.groupBy("t1", "t2").agg(F.sum("n").alias("n")).filter("n > 1"))
    return is_among(keyed, ["t1", "t2"], several, "copy", ["id"]).filter("copy").select(*_KEY, "n")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row."""
    every = F.array(F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last")))
    copies = stored(copied(docs))
    # rows that stand for many are told to every task, as in is_among
    total = copies.agg(F.sum("n")).first()[0] or 0
    hot = copies.filter(F.col("n") * HOT > total).select(*_KEY, every.alias("whole"))
    runs = repeats(docs).unionByName(copies.filter(F.col("n") * HOT <= total).select(*_KEY, F.lit(-1).alias("first"), F.lit(-1).alias("last")))
    marks = runs.groupBy(*_KEY).agg(F.collect_set(F.struct("first", "last")).alias("at")).withColumn("salt", F.lit(0))
    texts = _keyed(docs).drop("t2").join(F.broadcast(hot), _KEY, "left")
    salt = F.when(F.col("whole").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)).cast("int") + 1).otherwise(0)
    met = texts.withColumn("salt", salt).join(marks, [*_KEY, "salt"], "left").withColumn("at", F.coalesce("whole", "at"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in names[1:]]
            lists = b.column(2)
            for text, at in zip(b.column(1).to_pylist(), lists, strict=True):
                words = (text or "").encode().split()
                kept = words
                if at.is_valid and len(words) >= WINDOW:
                    runs = at.values
                    first, last = runs.field(0).to_numpy(), runs.field(1).to_numpy()
                    if (first < 0).any():
                        kept = []
                    else:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, first, 1)
                        np.add.at(edge, last + WINDOW, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        kept = [words[i] for i in np.flatnonzero(~gone)]
                joined = b" ".join(kept)
                for column, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()), strict=True):
                    column.append(v)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    small_batches(docs.sparkSession)
    return met.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), "text", "at").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
