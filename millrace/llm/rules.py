"""Quality rules: an isolation forest over rule statistics.

Each tree splits a small random sample of good labelled documents by random
thresholds of random statistics; a document that ends after few splits is
unlike them. The mean path length gives a score (higher: more
anomalous), and the limit is the score that separates labelled good from bad
documents best while it keeps nearly all good ones. The base rules fail a
document by themselves.

Repeated lines and digits are reported and not judged: licence lines and keys
stand in good documents too.

Nulls: a null text is an empty one (it has no words and fails the base rules).
Labels with nulls are ignored; without labels of both kinds the forest rejects
nothing. Repeated rows are judged one by one and alike; a score at the limit is
kept. A long text is measured whole. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table
from .hashing import Words, inside, mix, rows_of, slices, text_buffer, window_hashes
from .labelled import labelled_sample

#: Labelled documents that the forest and its limit are fitted on, at most.
LABELLED = 6000
TREES, TREE_ROWS, DEPTH = 128, 256, 10
#: Share of good labelled documents that the limit must keep.
KEEP_GOOD = 0.995

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def repeat_words(words: Words) -> np.ndarray:
    """Words of each row that lie in a 3-word window found twice or more in it."""
    rows = len(words.offsets) - 1
    n = len(words.start)
    if n < 3:
        return np.zeros(rows, np.int64)
    own = inside(words.offsets, 3)
    row = rows_of(words.offsets)[: n - 2]
    keys = window_hashes(words.hashes(), 3) ^ mix(row.astype(np.uint64) + np.uint64(1))
    place = np.flatnonzero(own)
    _, which, count = np.unique(keys[place], return_inverse=True, return_counts=True)
    again = place[count[which] > 1]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[again + k] = True
    return _per_row(covered, words.offsets)


def dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text, and characters of three kinds for the forest."""
    words = Words(texts)
    data, at = text_buffer(texts)
    spaces = (data == 32) | ((data >= 9) & (data <= 13))
    first = (data & 0xC0) != 0x80
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": _per_row(first & ~spaces, at),
        "n_symbols": _per_row(_SYMBOL[data], at),
        "n_dup_lines": np.array([dup_lines(t) for t in texts.to_pylist()], np.int64),
        "n_repeat_words": repeat_words(words),
        "n_upper": _per_row(_UPPER[data], at),
        "n_digits": _per_row(_DIGIT[data], at),
        "n_marks": _per_row(_MARK[data], at),
        "n_lines": _per_row(data == 10, at) + 1,
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """One column a rule: shares, so that length alone sets nobody apart, and
    their roots, so that small shares spread."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack([s["word_chars"] / words, np.sqrt(s["n_symbols"] / words), np.sqrt(s["n_upper"] / chars), np.sqrt(s["n_marks"] / words), np.sqrt(s["n_repeat_words"] / words)], axis=1)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Expected path length of a failed search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as arrays: node i splits on ``column`` at ``cut``; its children are
    2i + 1 and 2i + 2; at a leaf ``length`` is the path length.

    Trees hold ordinary documents, but thresholds are drawn from the whole box
    that ``reach`` spans: a statistic that is constant among ordinary documents
    still isolates one that differs."""

    def __init__(self, x: np.ndarray, reach: np.ndarray, seed: int = 5, trees: int = TREES, rows: int = TREE_ROWS):
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        self.depth = DEPTH
        size = 2 ** (self.depth + 1) - 1
        self.column = np.full((trees, size), -1, np.int16)
        self.cut = np.zeros((trees, size))
        self.length = np.zeros((trees, size))
        self.norm = self.depth + float(_mean_path(np.array(rows)))
        for t in range(trees):
            self._grow(t, 0, x[rng.choice(len(x), rows, replace=False)], reach.min(axis=0), reach.max(axis=0), 0, rng)

    def _grow(self, t: int, node: int, x: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, rng: np.random.Generator) -> None:
        self.length[t, node] = depth + float(_mean_path(np.array(len(x))))
        wide = np.flatnonzero(high > low)
        if depth == self.depth or len(x) < 2 or not len(wide):
            return
        c = int(rng.choice(wide))
        cut = rng.uniform(low[c], high[c])
        self.column[t, node], self.cut[t, node] = c, cut
        left = x[:, c] <= cut
        below, above = high.copy(), low.copy()
        below[c] = above[c] = cut
        self._grow(t, 2 * node + 1, x[left], low, below, depth + 1, rng)
        self._grow(t, 2 * node + 2, x[~left], above, high, depth + 1, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for column, cut, length in zip(self.column, self.cut, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                c = column[node]
                inner = c >= 0
                right = x[rows, np.maximum(c, 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.column) / self.norm)


def limit_from(good: np.ndarray, bad: np.ndarray, keep: float = KEEP_GOOD) -> float:
    """The score above which most bad and at most 1 - keep of the good lie."""
    if not len(good) or not len(bad):
        return np.inf
    cuts = np.unique(np.concatenate([good, bad]))
    lost = 1 - np.searchsorted(np.sort(good), cuts, "right") / len(good)
    caught = 1 - np.searchsorted(np.sort(bad), cuts, "right") / len(bad)
    gain = np.where(lost <= 1 - keep, caught - lost, -1)
    best = int(np.argmax(gain))
    # in the middle of the gap above the best cut
    return float((cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED, seed: int = 11) -> tuple[Forest | None, float]:
    names = ("quality", *BASE, "n_upper", "n_digits", "n_marks", "n_lines")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(2).cast(pa.int64()), *[pa.array(s[n]) for n in names[1:]]], list(names))

    sample = labelled_sample(docs, labels, bound, seed).select("doc_id", "text", "quality")
    rows = sample.mapInArrow(measure, ", ".join(f"{n} bigint" for n in names)).toPandas()  # bounded by ``bound``
    s = {n: rows[n].to_numpy() for n in names[1:]}
    x, bad = features(s) if len(rows) else np.zeros((0, 5)), rows["quality"].to_numpy() == 0
    order = np.lexsort(x.T) if len(x) else np.zeros(0, int)
    # what the base rules fail needs no forest
    order = order[~base_failed(s)[order]]
    x, bad = x[order], bad[order]
    if len(x) < 8 or bad.all():
        return None, np.inf
    forest = Forest(x[~bad], x)
    scores = forest.score(x)
    return forest, limit_from(scores[~bad], scores[bad])


def apply_rules(docs: DataFrame, forest: Forest | None, limit: float) -> DataFrame:
    """(doc_id, base counts, base_failed, anomaly, kept) of every document."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = statistics(b.column(1))
            failed = base_failed(s)
            score = forest.score(features(s)) if forest else np.zeros(b.num_rows)
            kept = ~failed & (score <= limit)
            columns = [b.column(0), *[pa.array(s[n]) for n in BASE], pa.array(failed), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, "base_failed", "kept", "anomaly"])

    small_batches(docs.sparkSession)
    schema = "doc_id bigint, " + ", ".join(f"{n} bigint" for n in BASE) + ", base_failed boolean, kept boolean, anomaly double"
    return docs.select("doc_id", "text").mapInArrow(judge, schema)


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, *fit(docs, table(spark, sf_dir, "labels")))
