"""Words and word windows of Arrow texts as 64-bit hashes, without string objects.

Words are ``[^\\x20\\x09-\\x0D]+``; in UTF-8 these bytes occur in no other
character, so bytes decide. A word's hash is a polynomial over its bytes, from
running sums, times the inverse power of its place; a window's hash is the same
over its words' hashes. ``seed`` picks the bases: two seeds give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; one document may exceed it, in steps of SEGMENT.
SLICE = 1 << 19
SEGMENT = 1 << 18
_BASES = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, int(n - 1).bit_length())
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS: dict[int, _Powers] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _POWERS.setdefault(base, _Powers(base)).get(n)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffer(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


class Words:
    """The words of some rows: ``start``/``end`` in ``data``, and ``offsets`` by row."""

    def __init__(self, texts: pa.Array):
        self.data, rows = text_buffer(texts)
        data = self.data
        solid = (data != 32) & ((data < 9) | (data > 13))
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        inner = rows[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = solid[inner]  # a row's end also ends a word
        ends[inner - 1] = solid[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.offsets = np.searchsorted(self.start, rows)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """One hash a word, by segments of bounded size that end between words."""
        base, n = _BASES[seed][0], len(self.start)
        out = np.empty(n, np.uint64)
        at = 0
        while at < n:
            first = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, first + SEGMENT, "right")))
            last = int(self.end[to - 1])
            up, down = _powers(base, last - first + 1)
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum((self.data[first:last].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            s, e = self.start[at:to] - first, self.end[at:to] - first
            out[at:to] = (sums[e] - sums[s]) * down[s]
            at = to
        return mix(out)


def window_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of the k words from each place; n - k + 1 of them, across rows too."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    out = np.empty(n - k + 1, np.uint64)
    for at in range(0, n - k + 1, SEGMENT):
        to = min(n - k + 1, at + SEGMENT)
        part = hashes[at : to + k - 1]
        up, down = _powers(_BASES[seed][1], len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=sums[1:])
        out[at:to] = (sums[k:] - sums[: len(sums) - k]) * down[: to - at]
    return mix(out)


def inside(offsets: np.ndarray, k: int) -> np.ndarray:
    """For each place that has a window of k words: whether it ends in its own row."""
    n = int(offsets[-1])
    if n < k:
        return np.zeros(0, bool)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return row[: n - k + 1] == row[k - 1 :]


def rows_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
