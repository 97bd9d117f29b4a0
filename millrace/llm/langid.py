"""Language ID by error-correcting output codes.

Every language has a codeword of bits; one binary classifier a bit, over
hashed letter n-grams, says how likely the bit is set. A text gets the language
whose codeword loses least against these answers, each bit weighted by how
well it did on documents held out of fitting. The score is the softmax of the
losses; ``ambiguous`` says that the second language is close.

The classifiers are fitted on a bounded sample of labelled documents (the same
share of each language's, up to the bound). Only texts are inputs.

Nulls: a null text, and one without any letter, is ``und`` with score 0; a null
language is no label. Without labels every text is ``und``. Repeated rows are
judged one by one and alike; of languages that lose alike the first by name is
taken. A long text is read whole. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, uniform
from .hashing import slices, text_buffer

#: Labelled documents that the classifiers are fitted on, at most; spread over languages.
LABELLED = 2400
BITS = 13
_SIZE = 1 << BITS
AMBIGUOUS = 0.1
UNKNOWN = "und"


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n rows of signs; of random draws, the one whose closest rows differ most.
    No bit is the same for all."""
    rng = np.random.default_rng(seed)
    length = max(7, 4 * int(np.ceil(np.log2(max(n, 2)))) + 3)
    best, most = np.ones((n, length)), -1
    for _ in range(500):
        code = rng.choice([-1.0, 1.0], (n, length))
        if n > 1 and (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = int(((length - code @ code.T) / 2 + np.eye(n) * length).min()) if n > 1 else length
        if apart > most:
            best, most = code, apart
    return best


def _clean(texts: pa.Array) -> pa.Array:
    """Lower case; what is no letter is one space."""
    low = pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)
    return pc.replace_substring_regex(low, r"[^\p{L}]+", " ")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Root shares of hashed 2- and 3-byte n-grams, a row each; which texts have a letter."""
    data, at = text_buffer(_clean(texts))
    n, size = len(texts), len(data)
    out = np.zeros(n * _SIZE, np.float32)
    wide = data.astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(at))
    for k in (2, 3):
        if size < k:
            continue
        gram = wide[: size - k + 1].copy()
        for i in range(1, k):
            gram |= wide[i : size - k + 1 + i] << np.uint32(8 * i)
        own = row[: size - k + 1] == row[k - 1 :]
        place = (gram + np.uint32(k << 24)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
        key = row[: size - k + 1][own] * _SIZE + place[own]
        out += np.bincount(key, minlength=n * _SIZE)
    x = out.reshape(n, _SIZE)
    total = np.maximum(x.sum(axis=1, keepdims=True), 1)
    solid = np.zeros(size + 1, np.int64)
    np.cumsum(data != 32, out=solid[1:])
    return np.sqrt(x / total), solid[at[1:]] > solid[at[:-1]]


class OutputCodes:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each row, and its softmax with the runner-up's."""
        answer = x @ self.weights + self.bias
        # logistic loss of each bit against each codeword, weighted by trust
        loss = np.stack([(np.logaddexp(0, -answer * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p


def fit_codes(x: np.ndarray, language: np.ndarray, languages: list[str], steps: int = 120, decay: float = 1e-5) -> OutputCodes:
    code = codewords(len(languages))
    held = np.arange(len(x)) % 5 == 0
    if not held.any() or held.all():
        held[:] = False

    def logistic(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nesterov steps on all bits at once."""
        z, y = x[rows], code[language[rows]]
        w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        ahead, ahead_b = w.copy(), b.copy()
        for step in range(steps):
            g = -y / (1 + np.exp(np.clip(y * (z @ ahead + ahead_b), -30, 30))) / len(z)
            new, new_b = ahead - 8.0 * (z.T @ g.astype(np.float32) + decay * ahead), ahead_b - 4.0 * g.sum(axis=0)
            pull = step / (step + 3)
            ahead, ahead_b = new + pull * (new - w), new_b + pull * (new_b - b)
            w, b = new.astype(np.float32), new_b.astype(np.float32)
        return w, b

    trust = np.ones(code.shape[1])
    if held.any():
        w, b = logistic(~held)
        right = ((x[held] @ w + b) * code[language[held]] > 0).mean(axis=0)
        trust = np.clip(2 * right - 1, 0.01, 1)
    w, b = logistic(np.ones(len(x), bool))
    return OutputCodes(languages, code, w, b, trust)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(rows: DataFrame, bound: int = LABELLED, seed: int = 31) -> OutputCodes | None:
    """``rows``: doc_id, text, lang, all fit to learn from."""
    rows = rows.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    languages = sorted(counts)
    if not languages:
        return None
    each = max(20, bound // len(languages))
    share = F.element_at(F.create_map(*[v for k, n in counts.items() for v in (F.lit(k), F.lit(min(1.0, each / n)))]), F.col("lang"))
    picked = rows.filter(uniform(F.lit(seed), "doc_id") < share).limit(2 * max(bound, each * len(languages))).select("doc_id", "text", "lang")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            x, letters = features(b.column(1))
            raw = [r.astype(np.float16).tobytes() if ok else None for r, ok in zip(x, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(raw, pa.binary())], ["doc_id", "lang", "x"])

    got = picked.mapInArrow(measure, "doc_id bigint, lang string, x binary").filter("x is not null").toPandas().sort_values(["doc_id", "lang"])
    if not len(got):
        return None
    languages = sorted(set(got["lang"]))
    x = np.stack([np.frombuffer(r, np.float16) for r in got["x"]]).astype(np.float32)
    index = {name: i for i, name in enumerate(languages)}
    return fit_codes(x, np.array([index[v] for v in got["lang"]]), languages)


def predict(docs: DataFrame, model: OutputCodes | None) -> DataFrame:
    """(doc_id, lang_pred, score, second, ambiguous) of every document."""
    names = ["doc_id", "lang_pred", "score", "second", "ambiguous"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                n = part.num_rows
                x, letters = features(part.column(1))
                if model is None:
                    letters[:] = False
                best, p = model.decode(x) if model else (np.zeros(n, int), np.ones((n, 1)))
                order = np.sort(p, axis=1)
                second = np.argsort(p, axis=1)[:, -2] if p.shape[1] > 1 else best
                name = lambda i: model.languages[i] if model else UNKNOWN
                top = np.where(letters, order[:, -1], 0.0)
                near = letters & (p.shape[1] > 1) & (order[:, -1] - order[:, max(0, p.shape[1] - 2)] < AMBIGUOUS)
                columns = [pa.array([name(i) if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)]), pa.array(top), pa.array([name(i) if ok and p.shape[1] > 1 else None for i, ok in zip(second, letters, strict=True)], pa.string()), pa.array(near)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, second string, ambiguous boolean")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "second", "ambiguous")
