"""Best-fit packing with certified bounds.

Documents become token ids and an end mark (id 0); only documents longer than a
sequence are cut. Pieces are dealt by hash into lots of bounded size and each
lot is packed by best-fit decreasing. Dual feasible functions give a lower
bound on the sequences a lot needs: where it is met, the lot is certified.
Lots with a gap give up the pieces of their unfilled sequences, and every lot
those of its emptiest, whose room only other lots' pieces can fill; these are
dealt into new lots and packed again, until nothing is open, one lot holds all
that is, or a round lowers neither the open pieces nor their sequences. What a
lot may then still be from the fewest sequences stands in ``gap``.

Nulls: a null text is an empty one, a single end mark. A null doc_id is a
document. Repeated rows are packed each, and dealt to lots by a number of the row, so
that no lot holds them all; pieces of one length are packed in the order of their
ids. A long text is tokenized whole, by one task. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, is_among, small_batches, table
from .hashing import slices

CAPACITY = 2048
#: Pieces of one lot.
LOT = 8000
#: Words that a worker remembers the ids of.
KNOWN_WORDS = 300_000


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as it is, the
    others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids of words as bytes; the tokenizer is asked when a word is new.

    The tokenizer drops white space and no token spans it, so the ids of a text
    are those of its parts between spaces or newlines. Parts of plain Latin
    letters and signs are normalised and split here and go to the tokenizer's
    model; all others (composed characters, other scripts or white space, marks
    of special tokens) go through the whole tokenizer."""

    SIMPLE = re.compile("[ -;=-~\n\u00a1-\u00ac\u00ae-\u012f\u0131-\u017e]*")
    # The split of the word tokenizer, and what it is for SIMPLE texts in lower case.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    _LETTERS, _DIGITS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017e", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    SPLIT_SIMPLE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+")

    def __init__(self, path: str, most: int = KNOWN_WORDS):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model, self.most = tokenizer.encode, tokenizer.model.tokenize, most
        self.split, self.simple = self.SPLIT_SIMPLE.findall, False
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        with open(path, "rb") as f:
            told = json.load(f)
        shapes = [told["normalizer"]["type"], told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]] if told.get("normalizer") and "pretokenizers" in (told.get("pre_tokenizer") or {}) else []
        self.plain = shapes[1:] == [self.SPLIT]

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            written = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            ids = self.parts[part] = struct.pack(f"<{len(got := self.model(written))}I", *[t.id for t in got])
        return ids

    def __missing__(self, word: str) -> bytes:
        if not word:
            ids = b""
        elif self.simple or self.plain and self.SIMPLE.fullmatch(word):
            ids = b"".join(map(self._part, self.split(word.lower())))
        else:
            ids = np.array(self.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        if len(self.parts) > self.most:
            self.parts.clear()
        self.simple = self.plain and self.SIMPLE.fullmatch(text) is not None
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole documents, or cuts of long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for b in slices(batches):
            out: list[list[int]] = [[] for _ in range(5)]
            for row, text in enumerate(b.column(1).to_pylist()):
                ids = memoryview(words.ids(text or "") + b"\0\0\0\0")
                for start in range(0, len(ids) // 4, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, v in zip(out, (row, start // capacity, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            doc = b.column(0).take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, *[pa.array(c, pa.int64()) for c in out[1:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins. Two families of dual feasible functions:
    sizes over capacity - t count as full and those under t as nothing, and
    sizes count as floor((k + 1) x) / k of the capacity."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    number, weight = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * x)])
    t = np.arange(0, capacity // 2 + 1)
    full = number[-1] - number[capacity - t + 1]
    middle = weight[capacity - t + 1] - weight[t]
    best = int(np.max(-(-(full * capacity + middle) // capacity)))
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        # k * value, in units of capacity; exact sizes keep their own value
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The bin of each length, and how many bins. Rooms of open bins are bits of
    one integer, so the tightest that fits is the lowest bit from the length on."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, at, n = capacity, n, n + 1
        bins[i] = at
        left = room - size
        if left:
            open_bins[left].append(at)
            rooms |= 1 << left
    return bins, n


_ROW = "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint"


def _pack_lot(lot: pd.DataFrame) -> pd.DataFrame:
    lot = lot.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
    lengths = lot["length"].to_numpy()
    bins, n = best_fit_decreasing(lengths)
    filled = np.bincount(bins, lengths, minlength=n)
    gap = n - lower_bound(lengths)
    by_bin = np.argsort(bins, kind="stable")
    sums = np.concatenate([[0], np.cumsum(lengths[by_bin])])[:-1]
    first = np.concatenate([[True], np.diff(bins[by_bin]) > 0])
    offset = np.empty(len(lot), np.int64)
    offset[by_bin] = sums - np.repeat(sums[first], np.diff(np.append(np.flatnonzero(first), len(lot))))
    return lot.assign(bin=bins, offset=offset, open=(filled[bins] < CAPACITY) & ((gap > 0) | (bins == filled.argmin())), gap=gap)


def pack(pieces: DataFrame, lot_rows: int = LOT, rounds: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to what ``tokenize`` returns; ``gap`` says how
    far a piece's lot may be from the fewest sequences. ``rounds`` is a bound for
    those who want one."""
    rest = cut(pieces.select("*", F.xxhash64("doc_id", "piece", "ids_crc32").alias("same"), F.monotonically_increasing_id().alias("row")))
    again = cut(rest.groupBy("same").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    if again.isEmpty():
        rest = rest.drop("same").withColumn("row", F.lit(None).cast("bigint"))
    else:  # rows that are equal are told apart by their number, all others go by what they are
        rest = is_among(rest, ["same"], again, "twice", ["row"])
        rest = cut(rest.withColumn("row", F.when(F.col("twice"), F.col("row"))).drop("same", "twice"))
    n, sequences, before, done = rest.count(), None, None, []
    for turn in count():
        lots = max(1, -(-n // lot_rows))
        key = F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32", "row"), F.lit(lots)).alias("lot")
        dealt = rest.select("*", key).groupBy("lot").applyInPandas(_pack_lot, f"{_ROW}, row bigint, lot bigint, bin bigint, offset bigint, open boolean, gap bigint")
        number = F.lit(turn).cast("long") * (1 << 48) + F.col("lot") * (1 << 20) + F.col("bin")
        packed = cut(dealt.withColumn("sequence_id", number))
        still = packed.filter("open")
        left, now = still.agg(F.count(F.lit(1)), F.countDistinct("sequence_id")).first()
        if left == n and before is not None and now >= sequences:
            done.append(before)  # nothing was won: those pieces stay as they were
            break
        if not left or lots == 1 or turn + 1 == rounds:
            done.append(packed)
            break
        done.append(packed.filter("not open"))
        rest, before, n, sequences = still.select("doc_id", "piece", "start", "length", "ids_crc32", "row"), still, left, now
    return reduce(DataFrame.unionByName, done).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(tokenize(docs, public_tokenizers.path("word_bpe_49k.json")))
