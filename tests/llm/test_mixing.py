"""Mixing against a queue that is worked off row by row."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing
from millrace.llm.common import uniform
from millrace.llm.mixing import mix_sources, mixed_documents, op1_mixing, sized_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, _id int, _times int, row int, tie string, which int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 1, 2, 3, "t", 4) for r in rows], DDL)


def documents(seed=3, n=400):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.choice([0, 1, 5, 20, 200]))), "en", r.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"])) for i in range(n)]
    rows += [(None, None, None, None), (7, "again and again", "en", "b"), (7, "another text", "en", "b"), (8, "", "en", "c"), (900, "long " * 3000, "en", "z")]
    return rows + [(11, "one row many times", "en", "a")] * 40 + [(None, "null id", "en", "a")] * 3


def shares(sizes, weights, budget, passes=2):
    """Targets by handing out the excess of full sources until none is above its limit."""
    full, target = set(), {}
    while True:
        left = budget - sum(passes * sizes[s] for s in full)
        total = sum(w for s, w in weights.items() if s not in full)
        target = {s: passes * sizes[s] if s in full else left * w / total for s, w in weights.items()}
        over = {s for s in target if s not in full and target[s] > passes * sizes[s]}
        if not over:
            return target
        full |= over


def by_hand(spark, rows):
    """What a queue takes: (doc_id, source, size) -> words, summed over equal rows."""
    docs = frame(spark, rows)
    count = {}
    for r in sized_documents(docs).collect():
        key = (r.doc_id, r.source, r.size, r.tie)
        count[key] = count.get(key, 0) + 1
    each = [(*k, i + 1) for k, n in count.items() for i in range(n)]
    df = spark.createDataFrame(each, "doc_id bigint, source string, size bigint, tie bigint, which bigint")
    places = [(r["p"], r) for r in df.select("*", uniform(F.lit(17), "doc_id", "tie", "which").alias("p")).collect()]
    names = sorted({r.source for _, r in places}, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    sizes = {s: sum(r["size"] for _, r in places if r.source == s) for s in names}
    budget = 1.5 * sum(sizes.values())
    queue = []
    for s in names:
        own, upto = sorted(((p, r) for p, r in places if r.source == s), key=lambda x: (x[0], -1 if x[1].doc_id is None else x[1].doc_id, x[1]["size"])), 0
        for _, r in own:
            upto += r["size"]
            queue += [((upto + sizes[s] * k) / weights[s], r) for k in range(2) if r["size"]]
    queue.sort(key=lambda x: x[0])
    taken, total, i = {(r.doc_id, r.source, r["size"], r.tie): 0 for _, r in places}, 0, 0
    while i < len(queue):
        same = [r for t, r in queue[i:] if t == queue[i][0]]
        if total + sum(r["size"] for r in same) > budget:
            break
        for r in same:
            taken[r.doc_id, r.source, r["size"], r.tie] += r["size"]
            total += r["size"]
        i += len(same)
    return taken, shares(sizes, weights, budget), sizes


@pytest.fixture(scope="module")
def case(spark):
    rows = documents()
    return rows, *by_hand(spark, rows)


def test_query(spark, tmp_path, case):
    rows, taken, targets, sizes = case
    frame(spark, rows).repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    out = op1_mixing(spark, str(tmp_path))
    assert [(c, dict(out.dtypes)[c]) for c in out.columns[:5]] == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    got = out.collect()
    low = lambda x: -1 if x is None else x
    assert sorted((low(g.doc_id), g["size"]) for g in got) == sorted((low(r[0]), len(WORD.findall(r[1] or ""))) for r in rows)
    sums = {}
    for g in got:
        assert g["size"] == 0 == g.taken or g.taken % g["size"] == 0 and g.taken <= 2 * g["size"]
        assert g.source_size == sizes[g.source] and abs(g.target - targets[g.source]) < 1e-6 * max(1, g.target)
        sums[g.source] = sums.get(g.source, 0) + g.taken
    want = {}
    for (_, s, _, _), n in taken.items():
        want[s] = want.get(s, 0) + n
    assert sums == want
    again = op1_mixing(spark, str(tmp_path)).repartition(3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_each_document(spark, case):
    rows, taken, _, _ = case
    got = {}
    for g in mix_sources(sized_documents(frame(spark, rows)), keep_tie=True).collect():
        key = (g.doc_id, g.source, g["size"], g.tie)
        got[key] = got.get(key, 0) + g.taken
    assert got == taken


@pytest.mark.parametrize("most", [0, 200_000])
def test_stage(spark, case, most):
    """The rows themselves, once for each time they are taken, whichever way ids are joined."""
    rows, taken, _, _ = case
    docs = frame(spark, rows).repartition(4)
    out = mixed_documents(docs, broadcast_rows=most)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got, want = {}, {}
    for x in out.collect():
        got[x.doc_id, x.source, x.text] = got.get((x.doc_id, x.source, x.text), 0) + 1
    ties = {(d["doc_id"], d["source"], d["tie"]): d["text"] for d in docs.select("doc_id", "source", F.xxhash64("text", "source").alias("tie"), "text").collect()}
    for (i, s, size, tie), words in taken.items():
        if words:
            want[i, s, ties[i, s, tie]] = words // size
    assert got == want
    assert out.count() < 2.01 * len(rows)


def test_exact_search_of_the_cut(spark, case):
    """Few ranges and few rows sorted at once: the search narrows in many rounds."""
    rows, taken, _, _ = case
    old = mixing.RANGES, mixing.EXACT_ROWS
    mixing.RANGES, mixing.EXACT_ROWS = 4, 3
    try:
        got = sum(g.taken for g in mix_sources(sized_documents(frame(spark, rows))).collect())
    finally:
        mixing.RANGES, mixing.EXACT_ROWS = old
    assert got == sum(taken.values())


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(1, "", "en", "s")], [(1, "a b", "en", "s")] * 3])
def test_awkward_tables(spark, rows):
    docs = frame(spark, rows)
    got = mix_sources(sized_documents(docs)).collect()
    assert len(got) == len(rows)
    words = sum(len(WORD.findall(r[1] or "")) for r in rows)
    assert words - 2 < sum(g.taken for g in got) * 2 / 3 <= words or not words
    assert mixed_documents(docs).count() == sum(g.taken // g["size"] for g in got if g["size"])
