"""Secret scans: fixed patterns, and assignment-aware lexing.

The fixed patterns give the spans ``assign``, ``access`` and ``hex``. Lexing
(``lexing``) reads source and configuration syntax as name-literal pairs, puts in
earlier constants of the same scope, and each literal is scored by how sensitive
the names are that it ends up under and by how random it looks. A literal over
the limit is a span ``literal``, where it is written, unless it lies within a
base span.

Whole texts are read, in a time that grows with their length. Nulls: a null text
is an empty one, a null doc_id is a document. Repeated rows are scanned one by one; spans
that start together are in the order of KINDS. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table
from .hashing import slices
from .lexing import Lexer, covered_by

KINDS = ("assign", "access", "hex", "literal")
# The base patterns and the least length of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: How much a part of a name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0,
    "signingkey": 1.0, "encryptionkey": 1.0, "credential": 0.9, "token": 0.9, "bearer": 0.8, "auth": 0.6, "salt": 0.5, "session": 0.4, "cookie": 0.4,
}
#: Values that stand for a secret without being one.
PLACEHOLDER = re.compile(r"(?i)example|change.?me|placeholder|your[_-]|dummy|sample|xxxx|\*\*\*\*|<|\$\{|^none$|^null$|^true$|^false$")
#: Short words, names in capitals, paths and addresses: what code puts under a sensitive name without giving the secret.
WORDLIKE = re.compile(r"(?=.{1,12}\Z)[a-z]+(?:[_-][a-z]+)*\Z|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\Z|[./~]|[a-z]+://")
LIMIT = 0.62
SHORTEST = 8
#: What is left of the weight of a name around the value's own, and names that take none.
AROUND = 0.6
PLAIN_NAMES = {"id", "name", "url", "uri", "host", "user", "username", "type", "path", "version", "date", "time", "file"}

def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each base match, by start and then kind."""
    spans = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


@lru_cache(1 << 14)  # names have NAME characters at most
def name_score(name: str) -> float:
    flat = re.sub(r"[^a-z]", "", name.lower())
    return max((score for part, score in SENSITIVE.items() if part in flat), default=0.0)


class Looks:
    """What a literal's score needs, so that joined literals cost no more than their parts."""

    __slots__ = ("counts", "length", "never")

    def __init__(self, value: str = ""):
        self.length, self.counts = len(value), Counter(value)
        self.never = " " in value or bool(PLACEHOLDER.search(value))

    def add(self, other: Looks) -> None:
        self.length += other.length
        self.counts.update(other.counts)
        self.never |= other.never

    def score(self) -> float:
        """0 to 1: long, varied, of several kinds of characters."""
        if self.length < SHORTEST or self.never:
            return 0.0
        entropy = -sum(n / self.length * math.log2(n / self.length) for n in self.counts.values())
        kinds = sum(any(test(c) for c in self.counts) for test in (_lower, _upper, _digit, lambda c: not (_lower(c) or _upper(c) or _digit(c))))
        return 0.5 * min(1.0, entropy / 3.5) + 0.2 * min(1.0, self.length / 20) + 0.3 * min(1.0, (kinds - 1) / 2)


def _lower(c: str) -> bool:
    return "a" <= c <= "z"


def _upper(c: str) -> bool:
    return "A" <= c <= "Z"


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def literal_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Literals that end up under sensitive names and look random, outside base spans.

    A value's score goes to every literal that it is joined of, directly or
    through constants: from later nodes to earlier ones, each link once."""
    if "=" not in text and ":" not in text and "(" not in text and "--" not in text:  # no pair without one of them
        return []
    told: list[tuple[int, float]] = []

    def found(names: tuple[str, ...], around: tuple[str, ...], node: int) -> None:
        own = max(map(name_score, names), default=0.0)
        if own < 1.0 and not any(n.lower().rsplit(".", 1)[-1] in PLAIN_NAMES for n in names):
            own = max(own, AROUND * max(map(name_score, around), default=0.0))
        if own:
            told.append((node, own))

    lexer = Lexer(text, found)
    if not told:
        return []
    needed = bytearray(len(lexer.parts))
    for node, _ in told:
        needed[node] = 1
    for node in range(len(needed) - 1, -1, -1):
        if needed[node]:
            for part in lexer.parts[node]:
                needed[part] = 1
    looks: dict[int, Looks] = {}
    for node in range(len(needed)):
        if needed[node]:
            at = lexer.literals[node]
            looks[node] = Looks(text[at[0] : at[1]]) if at else Looks()
            for part in lexer.parts[node]:
                looks[node].add(looks[part])
    best = [0.0] * len(lexer.parts)
    for node, own in told:
        at = lexer.literals[node]
        if at and WORDLIKE.match(text[at[0] : min(at[1], at[0] + 200)]):
            continue
        if score := looks[node].score():
            best[node] = max(best[node], 0.5 * own + 0.5 * score)
    for node in range(len(best) - 1, -1, -1):
        for part in lexer.parts[node]:
            best[part] = max(best[part], best[node])
    covered = covered_by([(s, e) for s, _, e in base])
    spans = {at for at, score in zip(lexer.literals, best, strict=True) if at and score >= LIMIT}
    return [(s, 3, e) for s, e in spans if not covered(s, e)]


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, as (start, kind, end) in code points."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + literal_spans(text, base))


def join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans) of every document."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in names[1:]]
            for text in b.column(1).to_pylist():
                base, every = scan(text)
                counts = Counter(k for _, k, _ in every)
                for column, v in zip(out, (*[counts[k] for k in range(4)], hashlib.sha256(join(base).encode()).hexdigest(), join(every)), strict=True):
                    column.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_literal bigint, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All columns, with each found span of ``text`` replaced by ``mark``."""
    at = docs.columns.index("text")

    def mask(text: str | None) -> str | None:
        if text is None:
            return None
        out, last = [], 0
        for start, _, end in scan(text)[1]:
            if start >= last:
                out += [text[last:start], mark]
            last = max(last, end)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            columns = list(b.columns)
            columns[at] = pa.array([mask(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal")
