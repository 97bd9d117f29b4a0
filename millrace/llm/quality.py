"""Quality classifier: cumulative-link regression on graded ratings.

A rating is an ordered grade: 0 to 2, one point each for quality and for not
being toxic. One weight vector over hashed text features gives a document's
place on a line; ordered thresholds cut the line into grades. The model gives
the expected grade and, for selection, the probability of the top grade.

Features of a text: each distinct word (letters alone, lower case), each
distinct ending of a word as written, and steps of three shares (distinct
words, capitals, symbols). All are hashed into one table of weights.

Nulls: a null or empty text has no words and gets the features of an empty one;
labels with nulls are ignored, and of repeated labels the worst counts. Without
labels of two grades every document is kept. Repeated rows are scored one by one and
alike; a probability at the limit is enough. A long text is read whole. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .hashing import Words, mix, slices
from .labelled import labelled_sample

#: Labelled documents that the model is fitted on, at most.
LABELLED = 8000
BITS = 18
GRADES = 3
#: Share of top-grade documents held out of fitting that selection must keep.
KEEP_TOP = 0.995
_SIZE = 1 << BITS


def _buckets(keys: np.ndarray, kind: int) -> np.ndarray:
    return (mix(keys ^ np.uint64((kind * 0x9E3779B97F4A7C15) % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int64)


def _letters(texts: pa.Array) -> pa.Array:
    """Lower case, with ASCII punctuation and digits as spaces."""
    low = pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)
    return pc.replace_substring_regex(low, "[!-@\\[-`{-~]+", " ")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs as two arrays, by row."""
    n = len(texts)
    words = Words(_letters(texts))
    rows = np.repeat(np.arange(n), words.counts)
    word = _buckets(words.hashes(), 1)
    raw = Words(texts)
    raw_rows = np.repeat(np.arange(n), raw.counts)
    last = np.zeros(len(raw.start), np.uint64)
    for i in range(1, 4):
        at = raw.end - i
        last = last * np.uint64(257) + np.where(at >= raw.start, raw.data[np.maximum(at, 0)], 0).astype(np.uint64)
    ending = _buckets(last, 2)
    pairs = np.unique(np.concatenate([rows * _SIZE + word, raw_rows * _SIZE + ending]))
    count = np.maximum(raw.counts, 1)
    distinct = np.bincount(np.unique(raw_rows * _SIZE + _buckets(raw.hashes(), 3)) // _SIZE, minlength=n) / count
    caps = np.bincount(raw_rows, ((raw.data[raw.start] >= 65) & (raw.data[raw.start] <= 90) & (raw.data[np.maximum(raw.end - 1, 0)] < 97)).astype(float), minlength=n) / count
    tail = raw.data[np.maximum(raw.end - 1, 0)]
    marks = np.bincount(raw_rows, np.isin(tail, np.frombuffer(b"#*$%&|<>!", np.uint8)).astype(float), minlength=n) / count
    steps = [np.minimum((share * 10).astype(np.int64), 9).astype(np.uint64) for share in (distinct, caps, marks)]
    shares = [np.arange(n) * _SIZE + _buckets(s, 4 + i) for i, s in enumerate(steps)]
    pairs = np.unique(np.concatenate([pairs, *shares]))
    return pairs // _SIZE, pairs % _SIZE


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class CumulativeLink:
    """P(grade <= k) = logistic(threshold[k] - place), thresholds ascending."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def place(self, rows: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, self.weights[which], minlength=n)

    def tail(self, place: np.ndarray) -> np.ndarray:
        """Columns: P(grade >= 1), P(grade >= 2), ..."""
        return 1 - _logistic(self.thresholds[None, :] - place[:, None])


def fit_cumulative_link(rows: np.ndarray, which: np.ndarray, grade: np.ndarray, steps: int = 150, decay: float = 3e-4, rate: float = 0.05) -> CumulativeLink:
    """Penalised maximum likelihood, by full-batch Adam steps."""
    n, levels = len(grade), GRADES - 1
    used, dense = np.unique(which, return_inverse=True)
    weights = np.zeros(len(used))
    # thresholds as a first value and positive gaps
    share = np.clip(np.array([(grade <= k).mean() for k in range(levels)]), 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    free = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    moments = [np.zeros(len(used) + levels), np.zeros(len(used) + levels)]
    for step in range(1, steps + 1):
        theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        place = np.bincount(rows, weights[dense], minlength=n)
        high, low = _logistic(bounds[grade + 1] - place), _logistic(bounds[grade] - place)
        p = np.maximum(high - low, 1e-9)
        slope = 1 - high - low
        g_theta = np.zeros(levels)
        for k in range(levels):
            g_theta[k] = (np.where(grade == k, -high * (1 - high) / p, 0) + np.where(grade == k + 1, low * (1 - low) / p, 0)).sum()
        g_free = np.concatenate([[g_theta.sum()], [g_theta[k:].sum() * np.exp(free[k]) for k in range(1, levels)]])
        g = np.concatenate([np.bincount(dense, slope[rows], minlength=len(used)) / n + decay * weights, g_free / n])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.999 * moments[1] + 0.001 * g * g
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        weights -= move[: len(used)]
        free -= move[len(used) :]
    theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
    table = np.zeros(_SIZE)
    table[used] = weights
    return CumulativeLink(table, theta)


def select_limit(top: np.ndarray, other: np.ndarray, keep: float = KEEP_TOP) -> float:
    """The tail probability that parts held-out documents best, and keeps ``keep`` of the top grade."""
    if not len(top) or not len(other):
        return 0.0
    cuts = np.linspace(0.01, 0.99, 99)
    lost, caught = (top[:, None] < cuts).mean(axis=0), (other[:, None] < cuts).mean(axis=0)
    gain = np.where(lost <= 1 - keep, caught - lost, -1 - lost)
    best = np.flatnonzero(gain == gain.max())
    return float(cuts[best[len(best) // 2]])


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, seed: int = 23) -> tuple[CumulativeLink | None, float]:
    """The model and the tail probability from which documents are selected."""
    small_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows, which = features(b.column(1))
            at = np.searchsorted(rows, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(which.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists], ["doc_id", "grade", "which"])

    sample = labelled_sample(docs, labels, bound, seed).select("doc_id", "text", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
    got = sample.mapInArrow(measure, "doc_id bigint, grade int, which array<int>").toArrow().sort_by("doc_id")  # bounded by ``bound``
    grade = np.clip(got.column("grade").to_numpy(), 0, GRADES - 1)
    if len(np.unique(grade)) < 2:
        return None, 0.0
    lists = got.column("which").combine_chunks()
    which = lists.flatten().to_numpy()
    count = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(grade)), count)
    held = mix(got.column("doc_id").to_numpy().astype(np.uint64)) % np.uint64(5) == 0
    kept = ~held[rows]
    renumber = np.cumsum(~held) - 1
    first = fit_cumulative_link(renumber[rows[kept]], which[kept], grade[~held])
    tail = first.tail(first.place(rows, which, len(grade)))[:, -1]
    top = grade == GRADES - 1
    limit = select_limit(tail[held & top], tail[held & ~top])
    return fit_cumulative_link(rows, which, grade), limit


def score(docs: DataFrame, model: CumulativeLink | None, limit: float) -> DataFrame:
    """(doc_id, expected_grade, top_probability, kept) of every document."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if model is None:
                tail = np.ones((b.num_rows, GRADES - 1))
            else:
                tail = model.tail(model.place(*features(b.column(1)), b.num_rows))
            columns = [b.column(0), pa.array(tail.sum(axis=1)), pa.array(tail[:, -1]), pa.array(tail[:, -1] >= limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "top_probability", "kept"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id bigint, expected_grade double, top_probability double, kept boolean")


def select_documents(docs: DataFrame, model: CumulativeLink | None, limit: float) -> DataFrame:
    """The rows of ``docs``, all columns, that reach the limit."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            if model is not None:
                tail = model.tail(model.place(*features(b.column(at)), b.num_rows))
                b = b.filter(pa.array(tail[:, -1] >= limit))
            yield b

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs, table(spark, sf_dir, "labels")))
