"""Every stage and the whole against plain Python on a small corpus."""

import collections
import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from millrace.llm import packing, quality, secrets  # noqa: E402

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id int, _t int, _tie int, _times int, row int, id int, t int, kept int, n int"
CLASH = (1, 2, 3, 4, 5, 6, 7, 8, 9)
V = "Zx81kQ9Lm2pR7w"


def corpus(seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(260):
        w = r.choices(vocab, k=r.randint(30, 120))
        poor, toxic = i % 6 == 0, i % 10 == 3
        if poor:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w[3] = w[20] = "vileword"
        if i % 8 == 1:
            w[5] = f'signing_key = "{V}{i}"'
        rows.append((i, " ".join(w), "en", f"s{i % 4}"))
        labels.append((i, int(not poor), int(toxic)))
    for i in range(40):  # near and exact copies
        w = rows[r.randrange(200)][1].split(" ")
        if i % 2:
            w[len(w) // 2] = "changed"
        rows.append((1000 + i, " ".join(w), "en", f"s{i % 4}"))
    rows += [(None, rows[1][1], "en", "s1"), (None, "two words", None, None), (5, "another text of id five " * 9, "en", "s2"), (2000, None, "en", "s0"), (2001, "", "en", "s0"), (2002, rows[2][1] + " tail" * 4000, "en", "s3")]
    rows += [rows[4]] * 5
    return [(i, t, lang, s, None if t is None else len(t), *CLASH) for i, t, lang, s in rows], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, labels = corpus()
    spark.createDataFrame(rows, DDL).repartition(4).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def bag(rows):
    return collections.Counter((r["doc_id"], r["text"], r["source"]) for r in rows)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def classes(rows):
    """For each row the rows that links of five-word shingles, 0.8 or more alike, lead to."""
    sets = []
    for r in rows:
        w = (r["text"] or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    linked = [[j for j in range(len(rows)) if j != i and x and len(x & sets[j]) >= 0.8 * len(x | sets[j])] for i, x in enumerate(sets)]
    out = []
    for i in range(len(rows)):
        reach, todo = {i}, [i]
        while todo:
            new = [j for j in linked[todo.pop()] if j not in reach]
            reach.update(new)
            todo += new
        out.append(frozenset(reach))
    return out


def run_stage(spark, name, docs, folder):
    out = stage(name)(spark, docs, folder)
    assert name == "packing" or out.dtypes == docs.dtypes
    return out.collect(), out


def test_stages_and_run(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = docs.collect()

    # quality: what the model's tail probability says of each text
    model, limit = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    got, out = run_stage(spark, "quality", docs, folder)
    import pyarrow as pa

    texts = pa.array([r["text"] for r in every], pa.string())
    tail = model.tail(model.place(*quality.features(texts), len(every)))[:, -1]
    assert bag(got) == bag(r for r, p in zip(every, tail, strict=True) if p >= limit)
    good = [r for r in every if r["doc_id"] is not None and r["doc_id"] < 260 and r["doc_id"] % 6 and r["doc_id"] % 10 != 3]
    kept = {r["doc_id"] for r in got}
    assert sum(r["doc_id"] in kept for r in good) >= 0.98 * len(good) and sum(i in kept for i in range(3, 260, 10)) <= 3

    # near duplicates: one of each class, of the smallest id; all without words stay
    for source, name in ((docs, "all"), (out, "kept")):
        rows = source.collect()
        left, after = run_stage(spark, "near_duplicates", source, folder)
        low = lambda r: -1 if r["doc_id"] is None else r["doc_id"]
        remains = bag(left)
        wordless = [r for r in rows if not (r["text"] or "").split()]
        groups = {g for g, r in zip(classes(rows), rows, strict=True) if (r["text"] or "").split()}
        assert sum(remains.values()) == len(groups) + len(wordless), name
        for g in groups:
            least = min(low(rows[j]) for j in g)
            ones = {(rows[j]["doc_id"], rows[j]["text"], rows[j]["source"]) for j in g}
            assert sum(remains[o] for o in ones) == 1 and all(low({"doc_id": o[0]}) == least for o in ones if remains[o])

    # secrets: every row stays, masked
    before = after.collect()
    masked, docs3 = run_stage(spark, "secrets", after, folder)

    def mask(text):
        for s, _, e in reversed(secrets.scan(text)[1]):
            text = text[:s] + "[secret]" + text[e:]
        return text

    assert bag(masked) == bag({**r.asDict(), "text": r["text"] and mask(r["text"])} for r in before)
    assert not any(V in (r["text"] or "") for r in masked) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in masked)

    # mixing: whole documents, each at most twice, near the budget
    mixed, docs4 = run_stage(spark, "mixing", docs3, folder)
    had, has = bag(masked), bag(mixed)
    size = lambda k: len((k[1] or "").split())
    assert all(n <= 2 * had[k] for k, n in has.items())
    budget = 1.5 * sum(size(k) * n for k, n in had.items())
    assert budget - max(map(size, had)) <= sum(size(k) * n for k, n in has.items()) <= budget

    # packing: every token of every document once, in sequences that are not over-full
    packed, _ = run_stage(spark, "packing", docs4, folder)
    tokens = packing.WordIds(__import__("public_tokenizers").path("word_bpe_49k.json"))
    want = collections.Counter()
    for (i, t, _), n in has.items():
        count = len(tokens.ids(t or "")) // 4 + 1
        for at in range(0, count, 2048):
            want[i, at // 2048, at, min(2048, count - at)] += n
    assert collections.Counter((p["doc_id"], p["piece"], p["start"], p["length"]) for p in packed) == want
    places = collections.defaultdict(list)
    for p in packed:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for seq in places.values():
        ends = np.cumsum([n for _, n in sorted(seq)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(seq)] == [0, *ends[:-1]]

    # the whole is its stages, one after another
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda p: (-1 if p["doc_id"] is None else p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_empty_and_null_tables(spark, tmp_path):
    for name, rows in (("empty", []), ("nulls", [(None,) * 5 + CLASH] * 3)):
        path = tmp_path / name
        spark.createDataFrame(rows, DDL).write.parquet(str(path / "documents.parquet"))
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
        # a null text has no words, so the mix takes none of it
        assert corpus_pipeline.run(spark, str(path)).count() == 0
