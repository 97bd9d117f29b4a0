"""N-gram Jaccard join: Bayesian pruning of MinHash candidates, exact verification.

A document is the set of its five-word shingles (of all its words if it has
fewer). Documents with equal sets are one class. MinHash bands propose classes
to compare; in each bucket MinHash values are compared in growing steps, and a
pair is dropped as soon as the posterior probability that its similarity
reaches the threshold (uniform prior) falls below a tolerance. What survives
is joined into candidate groups, and within each of these every pair is
verified exactly on the shingles. Neither step hands out pairs: buckets and
groups are worked on in blocks of bounded size, which return a count of links
and one link to a local centre for each document.

With 32 bands of 4 values a pair of similarity 0.8 shares no bucket with
probability 5e-8. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.

Nulls: a null text has no words; a document without words links with nothing.
A null doc_id is an id of its own kind. Repeated rows are copies of each other.
Ids need not be unique: classes are told apart by a hash of their shingles, rows
of one id by a hash of their text, and only the class_id is a doc_id.
A similarity of the threshold itself is a link. A long text is read whole, by one
task. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import deal_blocks, each_group, pairs_of, smallest_reachable
from .common import cut, looked_up, small_batches, table
from .components import components
from .hashing import Words, mix, slices, window_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: MinHash values compared before each decision, and the posterior that a pair must keep.
STEPS = (8, 16, 32, 64, 128)
TOLERANCE = 1e-7
#: Rows of a bucket's part, and of a candidate group's.
BUCKET_ROWS, GROUP_ROWS = 1024, 64
#: Rows of (id, group) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
NO_ID = -(2**63)

_RNG = np.random.default_rng(20_240)
_ODD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingle_sets(texts: pa.Array, seeds: tuple[int, ...] = (0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct shingles of each row as hashes (one array a seed, in one order), and row offsets."""
    words = Words(texts)
    n, counts = len(texts), words.counts
    row = np.repeat(np.arange(n), counts)
    full = len(row) >= SHINGLE
    own = (row[: len(row) - SHINGLE + 1] == row[SHINGLE - 1 :]) if full else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    rows = np.concatenate([row[: len(own)][own], short])
    out = []
    for seed in seeds:
        h = words.hashes(seed)
        one = np.array([window_hashes(h[words.offsets[r] : words.offsets[r + 1]], int(counts[r]), seed)[0] for r in short], np.uint64)
        out.append(np.concatenate([window_hashes(h, SHINGLE, seed)[own] if full else np.zeros(0, np.uint64), one]))
    order = np.lexsort((out[0], rows))
    rows = rows[order]
    out = [h[order] for h in out]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (out[0][1:] != out[0][:-1])
    return [h[new] for h in out], np.searchsorted(rows[new], np.arange(n + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def minhashes(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASHES minima of each row (all ones for a row without shingles)."""
    n = len(at) - 1
    out = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat((x ^ _XOR[k]) * _ODD[k], at[some])
    return out


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(id, text, t): the id without nulls, and a hash that tells texts of one id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), "text", F.xxhash64("text").alias("t"))


def sketch(docs: DataFrame) -> DataFrame:
    """(id, t, k1, k2, n, bands, sig): keys of the shingle set, band keys, and the
    low bytes of the MinHash values."""
    names = ["id", "t", "k1", "k2", "n", "bands", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            (h0, h1), at = shingle_sets(b.column(1), (0, 1))
            low = minhashes(h0, at)
            wide = low.astype(np.uint64).reshape(len(low), BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), wide.shape[:2])
            for i in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, i])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(low) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(key.astype(np.uint64).view(np.int64).ravel()))
            sig = pa.array([r.tobytes() for r in low.astype(np.uint8)], pa.binary())
            columns = [b.column(0), b.column(2), pa.array(_sums(mix(h0), at).view(np.int64)), pa.array(_sums(mix(h1), at).view(np.int64)), pa.array(np.diff(at)), bands, sig]
            yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession)
    return keyed_texts(docs).mapInArrow(run, "id bigint, t bigint, k1 bigint, k2 bigint, n bigint, bands array<bigint>, sig binary")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each step the matches below which a pair is dropped. Unequal values
    share their low byte once in 256."""
    s = np.linspace(0, 1, 4001)
    p = np.clip(s + (1 - s) / 256, 1e-12, 1 - 1e-12)
    out = []
    for n in STEPS:
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() / weight.sum() >= tolerance:
                break
        out.append(m)
    return out


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    done, matches = 0, np.zeros(len(a), np.int32)
    for n, m in zip(STEPS, least, strict=True):
        for at in range(0, len(a), 200_000):
            part = slice(at, at + 200_000)
            matches[part] += (sig[a[part], done:n] == sig[b[part], done:n]).sum(axis=1, dtype=np.int32)
        done = n
        keep = matches >= m
        a, b, matches = a[keep], b[keep], matches[keep]
    return a, b


def candidates(classes: DataFrame) -> DataFrame:
    """Links (a, b) that join what survives pruning; ``classes``: node, n, bands, sig."""
    least = least_matches()
    rows = classes.filter("n > 0").select(F.col("node").alias("id"), "bands", "sig")
    keys = rows.select("id", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = keys.join(full, "key").join(rows.select("id", "sig"), "id").select("key", "size", "id", "sig")
    dealt = deal_blocks(met, ["key"], F.col("size"), F.col("id"), BUCKET_ROWS).select("key", "lo", "hi", "id", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in each_group(batches, ["key", "lo", "hi"]):
            n = b.num_rows
            starts = starts[starts < n]
            sizes = np.diff(np.append(starts, n))
            ids = b.column("id").to_numpy()
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(n, HASHES)
            left, right = [], []
            for i, j in pairs_of(sizes, starts, 64):
                i, j = survivors(sig, i, j, least)
                left.append(i)
                right.append(j)
            for s, start in zip(sizes[sizes > 64], starts[sizes > 64], strict=True):
                for at in range(0, int(s), 64):  # a strip of rows against those from it on
                    i, j = np.meshgrid(np.arange(at, min(at + 64, s)), np.arange(at, s), indexing="ij")
                    upper = j > i
                    i, j = survivors(sig, start + i[upper], start + j[upper], least)
                    left.append(i)
                    right.append(j)
            a, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            # rows in the order of ids, so that the smallest row is the smallest id
            order = np.argsort(ids, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            label = smallest_reachable(n, rank[a], rank[c])
            moved = np.flatnonzero(label != np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(ids[order][moved]), pa.array(ids[order][label[moved]])], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def intersections(members: list[np.ndarray]) -> np.ndarray:
    """Common elements of each pair of sets: incidence products over tiles of
    the elements that two sets at least have."""
    g = len(members)
    every = np.concatenate(members)
    owner = np.repeat(np.arange(g), [len(m) for m in members])
    values, which, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count > 1
    renumber = np.cumsum(shared) - 1
    keep = shared[which]
    column, owner = renumber[which[keep]], owner[keep]
    out = np.zeros((g, g), np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((g, width), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m @ m.T
    return out


def verify(texts: DataFrame, groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, links, hub): exact links of each class (by node) within its candidate
    group, counted in copies, and its local centre. ``groups``: id, t, node, root,
    copies, size."""
    few = groups.count() <= BROADCAST_ROWS
    picked = texts.join(F.broadcast(groups) if few else groups, ["id", "t"]).select("node", "text", "root", "copies", "size")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            fresh = [i for i, node in enumerate(b.column(0).to_pylist()) if node not in seen and not seen.add(node)]  # repeated rows once
            if not fresh:
                continue
            rest = b.take(pa.array(fresh))
            (h,), at = shingle_sets(rest.column(1))
            raw = pa.array([h[at[i] : at[i + 1]].tobytes() for i in range(rest.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(2), rest.column(3), rest.column(4), raw], ["id", "root", "copies", "size", "shingles"])

    small_batches(texts.sparkSession)
    made = picked.mapInArrow(sets, "id bigint, root bigint, copies bigint, size bigint, shingles binary")
    dealt = deal_blocks(made, ["root"], F.col("size"), F.col("id"), GROUP_ROWS).select("root", "lo", "hi", "part", "id", "copies", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in each_group(batches, ["root", "lo", "hi"]):
            ids, part, copies = (b.column(c).to_numpy() for c in ("id", "part", "copies"))
            lo, hi = b.column("lo").to_numpy(), b.column("hi").to_numpy()
            raw = b.column("shingles")
            found: list[tuple] = []
            starts = starts[starts < b.num_rows]
            for start, end in zip(starts, np.append(starts[1:], b.num_rows), strict=True):
                own, first = np.unique(ids[start:end], return_index=True)  # repeated rows once
                at = start + first
                if len(at) < 2:
                    continue
                members = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in at]
                size = np.array([len(m) for m in members], np.float64)
                both = intersections(members)
                linked = both / (size[:, None] + size[None, :] - both) >= threshold
                np.fill_diagonal(linked, False)
                if lo[start] != hi[start]:
                    linked &= part[at][:, None] != part[at][None, :]
                links = linked @ copies[at]
                label = smallest_reachable(len(at), *np.nonzero(np.triu(linked)))
                some = links > 0
                found.append((own[some], links[some], own[label[some]]))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["id", "links", "hub"])

    return dealt.mapInArrow(run, "id bigint, links bigint, hub bigint")


def judged(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, t, n, class_id, n_links, kept) of every row; ``id`` and ``class_id`` are NO_ID for null."""
    # without words, nobody's copy
    node = F.xxhash64("k1", "k2", "n", F.when(F.col("n") == 0, F.col("id")))
    keyed = cut(sketch(docs)).withColumn("node", node)
    # the narrow aggregate first; what is wide comes along for one row a class
    grouped = keyed.groupBy("node").agg(F.min(F.struct("id", "t")).alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    grouped = cut(grouped.select("node", "first.id", "first.t", "n", "copies"))
    classes = grouped.join(keyed.select("id", "t", "bands", "sig"), ["id", "t"]).dropDuplicates(["id", "t", "node"])
    proposed = components(candidates(classes))
    roots = proposed.select(F.col("root").alias("node"), "root").distinct()
    members = cut(proposed.unionByName(roots))
    sizes = cut(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.col("n")))
    groups = looked_up(members, ["root"], sizes, ["size"], ["node"]).join(grouped.select("node", "id", "t", "copies"), "node")
    linked = cut(verify(keyed_texts(docs), cut(groups), threshold))
    final = components(linked.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    links = linked.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "node")
    told = cut(grouped.join(links, "node", "left").join(final, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # the first document of each class of classes, by id and then by text
    least = cut(told.groupBy("root").agg(F.min(F.struct("id", "t")).alias("least"), F.count(F.lit(1)).alias("n")))
    n_links = F.coalesce("links", F.lit(0)) + F.when(F.col("n") > 0, F.col("copies") - 1).otherwise(0)
    found = looked_up(told.select("node", "root", "copies", n_links.alias("n_links")), ["root"], least, ["least"], ["node"])
    found = cut(found.select("node", F.col("copies").alias("n"), "least", "n_links"))
    kept = (F.col("n") == 0) | ((F.col("id") == F.col("least.id")) & (F.col("t") == F.col("least.t")))
    out = looked_up(keyed.select("id", "t", "n", "node"), ["node"], found, ["least", "n_links"], ["id", "t"])
    return out.select("id", "t", "n", F.col("least.id").alias("class_id"), "n_links", kept.alias("kept"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, n_shingles, kept) of every row: the smallest
    doc_id that links lead to, other documents linked directly (copies too),
    and whether the row stays if one document of each class does. Rows that
    share both doc_id and text are told the same."""
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c if c != "id" else "doc_id")
    return judged(docs, threshold).select(real("id"), real("class_id"), "n_links", F.col("n").alias("n_shingles"), "kept")


def without_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, one of each class; those without words all stay."""
    found = cut(judged(docs, threshold).select("id", "t", "n", "kept"))

    def small(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys

    # the rows as one column, so that no name of theirs meets one of ours
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = whole.select("row", F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64("row.text").alias("t"))
    gone = found.filter("not kept").select("id", "t").distinct()
    rest = keyed.join(small(gone), ["id", "t"], "left_anti")
    repeated = cut(found.filter("kept and n > 0").groupBy("id", "t").count().filter("count > 1").select("id", "t"))
    if not repeated.isEmpty():
        repeated = small(repeated)
        once = rest.join(repeated, ["id", "t"], "left_semi").dropDuplicates(["id", "t"])
        rest = rest.join(repeated, ["id", "t"], "left_anti").unionByName(once)
    return rest.select("row.*")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
