"""The queries of operators that models, hashes or token ids make: their columns, their rules, awkward tables, and both ways of each join."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from millrace.llm import embeddings, langid, neardup, quality, rules, substrings
from millrace.llm.queries import ORACLE_SQL, QUERIES

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, t1 int, t2 int, node int, n int, size string, w1 string, seed int, row int, grade int, which int"
CLASH = (1, 2, 3, 4, 5, "x", "y", 6, 7, 8, 9)
COLUMNS = {
    "op1_mixing": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op2_quality": "doc_id:bigint expected_grade:double top_probability:double kept:boolean",
    "op3_jaccard": "doc_id:bigint class_id:bigint n_links:bigint",
    "op4_rules": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op5_sharding": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op6_embeddings": "vec_id:bigint n_links:bigint component_id:bigint kept:boolean",
    "op7_packing": "doc_id:bigint piece:bigint start:bigint length:bigint ids_crc32:bigint sequence_id:bigint",
    "op8_secrets": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op9_substrings": "doc_id:bigint n_words:bigint n_removed:bigint kept_sha256:string",
    "op10_langid": "doc_id:bigint held_out:boolean lang_pred:string score:double",
}


def put(spark, path, rows, labels=(), vectors=()):
    spark.createDataFrame([(*r, *CLASH) for r in rows], DDL).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int, text string").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(vectors), "vec_id bigint, embedding array<float>, label int, cell int, unit int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def corpus():
    r = random.Random(12)
    syllables = {"en": ["the", "ing", "th", "er", "and"], "de": ["sch", "ung", "ich", "ß", "der"], "fr": ["eau", "é", "oi", "que", "le"]}
    rows, labels = [], []
    for i in range(420):
        lang = list(syllables)[i % 3]
        w = ["".join(r.choices(syllables[lang], k=r.randint(1, 3))) for _ in range(r.randint(55, 140))]
        poor, toxic = i % 7 == 0, i % 11 == 4
        if poor:
            w = [x.upper() + "$$" for x in w]
        if toxic:
            w[5] = w[40] = "vileword"
        rows.append((i, " ".join(w), lang if i % 13 else None, f"s{i % 4}", 9))
        labels.append((i, int(not poor), int(toxic), "clash"))
    rows += [(1000 + i, rows[i][1], "en", "s1", 9) for i in range(20)]
    rows += [(None, "short", None, None, None), (None, None, None, None, None), (7, "12 345 !!", "en", "s", 1), (2, rows[8][1], "fr", "s0", 3), (3000, "wort " * 60_000, "de", "s", 1), (3001, "", "en", "s", 0)]
    return rows + [rows[4]] * 30, [*labels, (None, 1, 0, ""), (5, None, 1, ""), (3, 0, 0, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = np.random.default_rng(3)
    vectors = [(i, r.normal(size=6).tolist(), i % 3, 0, 0) for i in range(60)] + [(i % 50, r.normal(size=4).tolist(), 1, 0, 0) for i in range(20)]
    rows, labels = corpus()
    return put(spark, tmp_path_factory.mktemp("query"), rows, labels, vectors)


def same_rows(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, folder, name):
    out = QUERIES[name](spark, folder)
    kinds = dict(out.dtypes)
    assert [f"{c}:{kinds[c]}" for c in out.columns][: len(COLUMNS[name].split())] == COLUMNS[name].split()
    if name != "op7_packing":
        assert out.count() == spark.read.parquet(f"{folder}/{'embeddings' if name == 'op6_embeddings' else 'documents'}.parquet").count()


@pytest.mark.parametrize("name", COLUMNS)
@pytest.mark.parametrize("rows", [[], [(None,) * 5] * 2, [(1, "", "en", "s", 0)], [(1, "a", None, None, None), (1, "b", "x", "s", 1), (None, "a", None, "s", 1)]], ids=["empty", "nulls", "one empty text", "repeated ids"])
def test_awkward_tables(spark, tmp_path, name, rows):
    vectors = [(r[0], None if r[1] is None else [float(len(r[1]))] * 2, 1, 0, 0) for r in rows]
    path = put(spark, tmp_path, rows, [], vectors)
    out = QUERIES[name](spark, path)
    got = out.collect()
    assert len(got) == len(rows)
    key = out.columns[0]
    assert same_rows([g[key] for g in got], [r[0] for r in rows])


def test_quality(spark, folder):
    got = {}
    for g in QUERIES["op2_quality"](spark, folder).collect():
        got.setdefault(g.doc_id, []).append(g)
        assert 0 <= g.top_probability <= 1 and 0 <= g.expected_grade <= 2 and g.top_probability <= g.expected_grade
    right = sum(got[i][0].kept == (i % 7 != 0 and i % 11 != 4) for i in range(420) if i != 3)
    assert right >= 415
    # the fit itself: likelihood falls from the start, and place plus thresholds give the tail
    rows, which, grade = np.array([0, 0, 1, 2, 3]), np.array([5, 9, 5, 9, 11]), np.array([0, 2, 1, 2])
    m = quality.fit_cumulative_link(rows, which, grade)
    tail = m.tail(m.place(rows, which, 4))
    byhand = [[1 - 1 / (1 + np.exp(-(t - sum(m.weights[which[rows == k]])))) for t in m.thresholds] for k in range(4)]
    assert np.allclose(tail, byhand) and tail[1, -1] > tail[2, -1] > tail[0, -1]


def test_forest_paths():
    """Path lengths, walked node by node."""
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 3))
    f = rules.Forest(x, np.r_[x, x * 3], trees=8, rows=64)
    def walk(t, v):
        node = 0
        while f.column[t, node] >= 0:
            node = 2 * node + 1 + (v[f.column[t, node]] > f.cut[t, node])
        return f.length[t, node]
    want = [2 ** (-np.mean([walk(t, v) for t in range(8)]) / f.norm) for v in x[:40]]
    assert np.allclose(f.score(x[:40]), want)
    # a leaf's length is its depth and what a search among its rows would take
    leaf = f.column[0] < 0
    depth = np.floor(np.log2(np.arange(len(f.cut[0])) + 1))
    assert (f.length[0][leaf & (f.length[0] > 0)] >= depth[leaf & (f.length[0] > 0)]).all()


def test_rules(spark, folder):
    docs = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        docs.setdefault((r.doc_id, len((r.text or "").split())), r.text)
    for g in QUERIES["op4_rules"](spark, folder).collect():
        w = (docs[g.doc_id, g.n_words] or "").split()
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)})
        assert (g.word_chars, g.n_repeat_words) == (sum(map(len, w)), repeat)
        assert g.base_failed == (len(w) < 50 or 100 * repeat > 50 * len(w)) and not (g.kept and g.base_failed)
        if g.doc_id is not None and g.doc_id < 420 and not g.base_failed and len(w) > 50:
            assert g.kept == (g.doc_id % 7 != 0)


def test_language(spark, folder):
    rows, _ = corpus()
    truth = {i: list(("en", "de", "fr"))[i % 3] for i in range(420)}
    got = QUERIES["op10_langid"](spark, folder).collect()
    held = [g for g in got if g.held_out]
    assert all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got)
    known = [g for g in held if g.doc_id in truth and g.doc_id != 2 and g.lang_pred != "und"]
    assert len(known) > 80 and sum(g.lang_pred == truth[g.doc_id] for g in known) >= 0.98 * len(known)
    letters = collections.Counter(any(c.isalpha() for c in r[1] or "") for r in rows)
    assert sum(g.lang_pred == "und" for g in got) == letters[False] and all(0 <= g.score <= 1 for g in got)
    # decoding: the codeword that loses least, each bit by its trust
    model = langid.OutputCodes(["a", "b", "c"], langid.codewords(3), np.eye(4, 11), np.zeros(11), np.linspace(0.2, 1, 11))
    x = np.random.default_rng(0).normal(size=(9, 4))
    best, p = model.decode(x)
    for k in range(9):
        answer = x[k] @ model.weights
        loss = [sum(t * np.log1p(np.exp(-a * c)) for a, c, t in zip(answer, word, model.trust, strict=True)) for word in model.code]
        assert best[k] == int(np.argmin(loss)) and np.isclose(p[k].sum(), 1)


def test_substrings_with_repeated_and_null_ids(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    every = [[x.encode() for x in (t or "").split()] for _, t in docs]
    seen = collections.Counter(hash(tuple(w[i : i + 35])) for w in every for i in range(len(w) - 34))
    want = []
    for (i, _), w in zip(docs, every, strict=True):
        edge = np.zeros(len(w) + 1, int)
        for k in range(len(w) - 34):
            if seen[hash(tuple(w[k : k + 35]))] > 1:
                edge[k] += 1
                edge[k + 35] -= 1
        kept = [x for x, g in zip(w, np.cumsum(edge), strict=False) if not g]
        want.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    got = QUERIES["op9_substrings"](spark, folder).collect()
    assert same_rows(map(tuple, got), want)


@pytest.mark.parametrize("name, module, names", [("op3_jaccard", neardup, {"BROADCAST_ROWS": 0, "BUCKET_ROWS": 8, "GROUP_ROWS": 4}), ("op9_substrings", substrings, {"BROADCAST_ROWS": 0, "HOT": 1}), ("op6_embeddings", embeddings, {"CELL": 5, "MOST_PIVOTS": 7, "BLOCK_ROWS": 3, "STRIP": 2})])
def test_large_ways_give_the_same(spark, folder, monkeypatch, name, module, names):
    """What runs beyond the bounds of broadcasts and blocks."""
    usual = QUERIES[name](spark, folder).collect()
    for k, v in names.items():
        monkeypatch.setattr(module, k, v)
    if "HOT" in names:  # and every key apart
        monkeypatch.setattr("millrace.llm.common.HOT", 1 << 40)
    assert same_rows(QUERIES[name](spark, folder).collect(), usual)


def test_sql_has_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_repeated_pieces_go_to_many_lots(spark):
    """Equal rows are dealt apart, and each is packed."""
    from millrace.llm import packing

    rows = [(None, 0, 0, 700, 5)] * 900 + [(i, 0, 0, 600, i) for i in range(100)]
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint").repartition(3)
    got = packing.pack(pieces, lot_rows=50).toPandas()
    assert len(got) == 1000 and got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["doc_id"].isna().sum() == 900
    lots = (got[got["doc_id"].isna()]["sequence_id"] // (1 << 20)).value_counts()
    assert lots.max() < 120 and got["sequence_id"].nunique() <= 450 + 34
