"""Sharding: sizes, checksums, slots and groups of the query's result, held against the table itself."""

import random
import zlib

import pytest

from millrace.llm import sharding
from millrace.llm.sharding import kd_shards, op5_sharding

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard int, u double"


def table(spark, path, rows):
    spark.createDataFrame([(*r, "x", 3, 0.5) for r in rows], DDL).repartition(5).write.parquet(str(path / "documents.parquet"))


def check(rows, got, shards=40):
    """The contract, and at most ``shards - 1`` groups of equal texts in several shards."""
    key = lambda i, t: (-1 if i is None else i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sorted(key(r[0], r[1]) for r in rows) == sorted((-1 if g.doc_id is None else g.doc_id, g["size"], g.text_crc32) for g in got)
    slots, groups = {}, {}
    for g in got:
        assert 0 <= g.shard < shards and g.law == "bytes" and g.grown_shard is None
        slots.setdefault(g.shard, []).append(g.slot)
        groups.setdefault((g["size"], g.text_crc32), set()).add(g.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for s in groups.values()) <= shards - 1
    return groups


def bytes_by_shard(got, shards=40):
    out = [0] * shards
    for g in got:
        out[g.shard] += g["size"]
    return out


def test_query(spark, tmp_path):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefé", k=6))
    base = [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(900)]
    texts = base + [r.choice(base[:80]) for _ in range(600)] + [base[0]] * 1200 + [None] * 9 + [""] * 30
    rows = [(i if i % 9 else i // 100 or None, t, r.choice(["en", "de", None]), f"s{r.randrange(12)}" if i % 5 else "hot", len(t or "") if i % 11 else None) for i, t in enumerate(texts)]
    rows += [rows[3]] * 300  # one row again and again
    table(spark, tmp_path, rows)
    out = op5_sharding(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert [dict(out.dtypes)[c] for c in out.columns] == ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]
    got = out.collect()
    groups = check(rows, got)
    per = bytes_by_shard(got)
    mean, largest = sum(per) / 40, max(g["size"] for g in got)
    # six cuts above a shard, each exact to a row and a thousandth of a shard
    assert max(abs(b - mean) for b in per) <= 6 * (largest + 0.001 * mean)
    hot = groups[len(base[0].encode()) + 16, zlib.crc32(base[0].encode())]
    assert 1200 * (len(base[0].encode()) + 16) > mean and len(hot) > 1  # larger than a shard, so divided


def test_small_groups_stay_whole(spark):
    """Copies of less than a thousandth of a shard are never divided, whatever the cut."""
    rows = [(i, f"text {i // 3} " + "x" * 50, "en", f"s{i // 3 % 7}", 10) for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = kd_shards(docs, 4, ("lang", "source", "n_chars")).collect()
    at = {}
    for g in got:
        at.setdefault(g.doc_id // 3, set()).add(g.shard)
    assert all(len(s) == 1 for s in at.values())
    per = bytes_by_shard(got, 4)
    assert max(per) - min(per) < 0.02 * sum(per) / 4


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "a", "en", "s", 1)] * 3, [(i, "same", "en", "s", 4) for i in range(500)], [(i, "x" * (200_000 if i == 7 else 3), "en", "s", 4) for i in range(100)]], ids=["empty", "nulls", "repeats", "one text", "long text"])
def test_awkward_tables(spark, tmp_path, rows):
    table(spark, tmp_path, rows)
    got = op5_sharding(spark, str(tmp_path)).collect()
    check(rows, got)
    if len(rows) == 500:
        per = bytes_by_shard(got)
        assert max(per) - min(per) <= 6 * got[0]["size"]


def test_both_joins_agree(spark):
    rows = [(i, f"t{i % 50}", "en", f"s{i % 3}", i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    old, results = sharding.WIDE, []
    for sharding.WIDE in (1, 1 << 40):  # no group is told to all tasks; every group is
        results.append(sorted(map(tuple, kd_shards(docs, 8, ("lang", "source", "n_chars")).select("doc_id", "shard").collect())))
    sharding.WIDE = old
    assert results[0] == results[1]
