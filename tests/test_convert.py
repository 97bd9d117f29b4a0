import datetime
import gzip
import os
import random

import pyarrow.parquet as pq
import pytest

from millrace import Config, convert, infer_schema, to_dataframe
from millrace.functions.jsonwalk import BadLine, leaves, parse_object
from millrace.functions.numbers import six_decimals
from millrace.functions.timestamps import timestamp_micros, timestamp_micros_py
from millrace.operators.convert import collect_errors
from millrace.operators.extract import verbatim
from millrace.plans.config import ColumnSchema, LogicalType, PipelineState, Projection
from millrace.sources.sinks import read_dump

T = LogicalType


def put(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_error_policies(spark, tmp_path):
    src = put(tmp_path, "log.jsonl", ['{"n":7}', "oops", "", '{"n":9}', " ", '{"n":1} x', '{"n":1}{"n":2}', '{"n":5}\r'])
    out = str(tmp_path / "log.parquet")
    s = convert(spark, Config((src,), out, on_error="collect"))
    assert (s.rows_read, s.rows_written, s.rows_skipped, s.final_state) == (3, 3, 4, PipelineState.DONE)
    assert [(e.line_no, e.raw) for e in s.errors] == [(2, "oops"), (4, " "), (5, '{"n":1} x'), (6, '{"n":1}{"n":2}')]
    assert sorted(rows(spark.read.parquet(out))) == [(5,), (7,), (9,)]
    few = convert(spark, Config((src,), out, on_error="collect", max_errors=1))
    assert len(few.errors) == 1 and few.rows_skipped == 4
    gone = tmp_path / "gone.parquet"
    s = convert(spark, Config((src,), str(gone), on_error="abort"))
    assert s.final_state is PipelineState.ABORTED and s.reason == "invalid JSON" and not gone.exists()


def test_types_and_paths(spark, tmp_path):
    lines = ['{"value":1,"s":"12","r":{"code":200,"d":{"e":{"f":1}}},"l":[1, 2],"big":18446744073709551615,"e":{}}', '{"s":"x","value":null,"r":5}', "{}"]
    df = to_dataframe(spark, Config((put(tmp_path, "t.jsonl", lines[:1]),), print_schema=True))
    assert df.columns == ["value", "s", "r.code", "r.d.e.f", "l", "big"]
    assert rows(df) == [(1, "12", 200, 1, "[1,2]", -1)]
    deep = to_dataframe(spark, Config((put(tmp_path, "d.jsonl", ['{"a":{"b":{"c":{"d":{"e":1}}}}}']),), print_schema=True))
    assert deep.columns == ["a.b.c.d"] and rows(deep) == [('{"e":1}',)]
    twice = to_dataframe(spark, Config((put(tmp_path, "k.jsonl", ['{"a":1,"a":2}']),), print_schema=True))
    assert rows(twice) == [(1,)]


def test_widening_after_sample(spark, tmp_path):
    src = put(tmp_path, "w.jsonl", ['{"v":1}'] * 20 + ['{"v":2.5}'])
    out = str(tmp_path / "w.parquet")
    assert convert(spark, Config((src,), out, sample_lines=5)).rows_written == 21
    assert spark.read.parquet(out).dtypes == [("v", "double")]
    assert convert(spark, Config((src,), out, sample_lines=5, type_conflict="error")).final_state is PipelineState.ABORTED
    fixed = convert(spark, Config((src,), out, sample_lines=5, threads=2, on_error="collect"))
    assert fixed.rows_skipped == 1 and fixed.errors[0].reason == "value does not fit fixed schema column"


def test_full_scope_sees_late_columns(spark, tmp_path):
    src = put(tmp_path, "f.jsonl", ['{"a":1}'] * 9 + ['{"b":true}'])
    names = lambda **k: [c.name for c in infer_schema(spark, Config((src,), print_schema=True, sample_lines=3, **k)).columns]
    assert names() == ["a"] and names(infer_scope="full") == ["a", "b"]


def test_inputs_in_order(spark, tmp_path):
    b = put(tmp_path, "b.jsonl", ['{"b":1}'])
    a = tmp_path / "a.jsonl.gz"
    a.write_bytes(gzip.compress(b'{"a":1}\r\n\n{"a":2}'))
    cfg = Config((b, str(a)), print_schema=True)
    assert to_dataframe(spark, cfg).columns == ["b", "a"]
    assert sorted(rows(to_dataframe(spark, cfg)), key=str) == [(1, None), (None, 1), (None, 2)]
    bad = put(tmp_path, "bad.jsonl", ["x"])
    assert rows(collect_errors(spark, Config((b, bad), print_schema=True))) == [(2, "invalid JSON", "x")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        to_dataframe(spark, Config((str(tmp_path / "none"),), print_schema=True)).collect()


def test_override_projection_dump(spark, tmp_path):
    src = put(tmp_path, "o.jsonl", ['{"code":200,"x":0.0000005,"b":true,"t":"2026-02-31T10:00:00Z"}', '{"code":404}'])
    over = (ColumnSchema("code", T.STRING), ColumnSchema("x", T.STRING), ColumnSchema("again", T.INT64, True, "code"))
    cfg = Config((src,), str(tmp_path / "o.dump"), "columnar-raw", schema_override=over, projection=Projection(exclude=("zz",), rename=(("b", "flag"),)))
    assert convert(spark, cfg).final_state is PipelineState.DONE
    back = read_dump(spark, str(tmp_path / "o.dump"))
    assert back.columns == ["code", "x", "flag", "t", "again"]
    assert [tuple(r)[:3] + (r["again"],) for r in back.collect()] == [("200", "0.000000", True, 200), ("404", None, None, 404)]
    assert (tmp_path / "o.dump").read_bytes()[:12] == b"COLDUMP1\x05\0\0\0"


def test_native(spark, tmp_path):
    src = put(tmp_path, "n.jsonl", ['{"id":1,"geo":{"lat":1.5},"tags":[1,2]}', '{"id":"x","geo":{"lat":2}}', "[1]"])
    df = to_dataframe(spark, Config((src,), print_schema=True, nested="native"))
    assert [tuple(r) for r in df.select("id", "geo.lat", "tags").collect()] == [("1", 1.5, [1, 2]), ("x", 2.0, None)]
    strict = put(tmp_path, "s.jsonl", ['{"a":1}', '{"a":2}{"b":3}', '{"a":3} ,', "7", '{"a":"x"}'])
    s = convert(spark, Config((strict,), str(tmp_path / "s.parquet"), nested="native", on_error="collect"))
    assert s.rows_written == 2 and [(e.line_no, e.reason) for e in s.errors] == [(2, "invalid JSON"), (3, "invalid JSON"), (4, "top-level value is not an object")]
    late = put(tmp_path, "late.jsonl", ['{"a":1}'] * 5 + ['{"a":2.5,"z":{"y":true}}'])
    one = to_dataframe(spark, Config((late,), print_schema=True, nested="native", sample_lines=2, infer_scope="full"))
    assert dict(one.dtypes) == {"a": "double", "z": "struct<y:boolean>"}
    with pytest.warns(UserWarning, match="ignores"):
        to_dataframe(spark, Config((src,), print_schema=True, nested="native", projection=Projection(select=("id",))))


def test_timestamp_twin(spark):
    texts = ["1970-01-01T00:00:00Z", "2026-02-31T10:00:60.1234567+03:00", "0001-01-01T00:00:00", " 2026-1-2T3:4:5", "x", "2026-00-01T00:00:00", "1969-12-31T23:59:59.5"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(timestamp_micros(_col("t"))).collect()
    assert [r[0] for r in got] == [timestamp_micros_py(t) for t in texts]


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_extract_agrees_with_walker(spark, tmp_path):
    lines = ['{"a":1,"b":[true, null],"c":{"d":"x","e":1e3}}', '{"a":null,"c":{"d":"y"}}', "{", '{"a":7,"b":[],"c":{"e":0.5}}']
    df = to_dataframe(spark, Config((put(tmp_path, "p.jsonl", lines),), print_schema=True))
    want = []
    for line in lines:
        try:
            got = leaves(parse_object(line))
            want.append(tuple(got.get(c, (None, None))[1] for c in df.columns))
        except BadLine:
            pass
    assert rows(df) == want


def test_verbatim():
    assert verbatim('{"a": {"b": [1,  2.50]} , "c.d":{ "x":1 }}', "a.b") == "[1,  2.50]"
    assert verbatim('{"c.d":{ "x":1 }}', "c.d") == '{ "x":1 }' and verbatim("{}", "a") is None


def random_line(r):
    key = lambda: r.choice(["a", "b", "c", "o", "p", "t"])
    leaf = lambda: r.choice(["1", "-0", "2.50", "1e3", "true", "null", '"x"', '"12"', '"1.5"', '"[1]"', "[1, 2.0]", '"2031-04-05T06:07:08.5Z"', '"2031-4-5T6:7:8"', "18446744073709551615", "99999999999999999999999", '""', '"{"', "{}"])
    obj = lambda d: "{" + ", ".join(f'"{key()}"{r.choice(["", " "])}: {obj(d - 1) if d and r.random() < 0.3 else leaf()}' for _ in range(r.randint(0, 4))) + "}"
    return r.choice([obj(4)] * 12 + ["", " ", "[1]", "7", "{", '{"a":1} {}', '{"a":01}', "{'a':1}", '{"a":NaN}', "null", '{"o.p":true}', '{"t":1, "o.p" : "y"}'])


@pytest.mark.parametrize("seed", range(6))
def test_typed_reading_agrees_with_walker(spark, tmp_path, seed):
    """Whatever the mix of types: the walker's leaves, by the rules of their columns."""
    r = random.Random(seed)
    lines = [x for x in (random_line(r) for _ in range(150)) if x]
    if seed % 2:  # one type a path, so that the fast reading gets its share
        lines = [f'{{"a":{i},"b":{i}.25,"c":"w{i}","o":{{"p":{str(i % 2 == 0).lower()}}},"t":"2031-04-05T06:07:{i % 60:02d}Z"}}' for i in range(100)] + lines
    cfg = Config((put(tmp_path, "r.jsonl", lines),), print_schema=True, sample_lines=40 if seed > 2 else 10_000)
    schema = infer_schema(spark, Config(cfg.inputs, print_schema=True, infer_scope="full"))
    df = to_dataframe(spark, Config(cfg.inputs, print_schema=True, infer_scope="full"))
    want = []
    for line in lines:
        try:
            got = leaves(parse_object(line))
        except BadLine:
            continue
        want.append(tuple(as_column(*got.get(c.json_path, (T.NULL, None)), c.type) for c in schema.columns))
    assert [tuple(plain(v) for v in x) for x in rows(df)] == want
    auto = to_dataframe(spark, cfg)
    known = {c.name: i for i, c in enumerate(schema.columns)}
    if cfg.sample_lines < 100:
        assert all([plain(x[i]) for x in rows(auto)] == [w[known[c]] for w in want] or dict(auto.dtypes)[c] != dict(df.dtypes)[c] for i, c in enumerate(auto.columns))


def plain(v):
    return (v - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1) if isinstance(v, datetime.datetime) else v


def as_column(kind, v, column):
    if v is None or column is T.NULL:
        return None
    if column is T.STRING:
        return v if isinstance(v, str) else str(v).lower() if kind is T.BOOL else str(v) if kind is T.INT64 else f"{v:.6f}"
    if column is T.TIMESTAMP:
        return timestamp_micros_py(v)
    return float(v) if column is T.DOUBLE else v


def test_six_decimals(spark):
    xs = [0.0, -0.0, 5e-7, 1.5e-6, 2.5e-6, 7.75e-05, -1e-9, 0.9999995, 1e22, 1e23, 2.0**53 + 2, 2.0**64 + 4096, 123456789.1234565, 1 / 64 + 1 / 128, float("nan")] + [float(f"{k}.5e-6") for k in range(300)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(six_decimals(_col("x"))).collect()
    assert [r[0] for r in got] == [None if x != x else f"{x:.6f}" for x in xs]


def test_outputs_without_columns(spark, tmp_path):
    empty = tmp_path / "empty.jsonl"
    empty.write_text("")
    for single in (False, True):
        out = str(tmp_path / f"none{single}.parquet")
        s = convert(spark, Config((str(empty),), out, single_file=single))
        assert s.final_state is PipelineState.DONE and s.bytes_out > 0
        file = out if single else f"{out}/part-00000.parquet"
        assert pq.read_table(file).num_columns == 0
    dump = str(tmp_path / "none.dump")
    convert(spark, Config((str(empty),), dump, "columnar-raw"))
    assert open(dump, "rb").read() == b"COLDUMP1\0\0\0\0"


def test_batches_and_order(spark, tmp_path):
    paths = [put(tmp_path, f"{n}.jsonl", [f'{{"at":{n * 1000 + i},"text":"{"x" * (i % 7)}"}}' for i in range(400)]) for n in range(3)]
    out = str(tmp_path / "one.parquet")
    convert(spark, Config(tuple(paths), out, single_file=True, batch_rows=100))
    file = pq.ParquetFile(out)
    assert file.read()["at"].to_pylist() == [n * 1000 + i for n in range(3) for i in range(400)]
    assert max(file.metadata.row_group(i).num_rows for i in range(file.num_row_groups)) <= 100
    convert(spark, Config(tuple(paths), out, ordered=True))
    parts = sorted(os.path.join(out, f) for f in os.listdir(out) if f.startswith("part-"))
    assert [x for f in parts for x in pq.read_table(f)["at"].to_pylist()] == [n * 1000 + i for n in range(3) for i in range(400)]
    dump = str(tmp_path / "one.dump")
    for more in ({"batch_rows": 64}, {"batch_bytes": 200}):
        convert(spark, Config(tuple(paths), dump, "columnar-raw", **more))
        assert [r["at"] for r in read_dump(spark, dump).collect()] == [n * 1000 + i for n in range(3) for i in range(400)]


def test_many_inputs_are_one_scan(spark, tmp_path):
    """Files of odd names, folders and repeats, each line with its place in the list of inputs."""
    import zstandard

    inputs, want = [], []
    for i in range(12):
        name, lines = f"q {i % 3}%20é+#{i}.jsonl", [f'{{"a":{10 * i}}}', "", "x", f'{{"a":{10 * i + 1}}}']
        if i % 3 == 0:
            path = tmp_path / f"{name}.zst"
            path.write_bytes(zstandard.ZstdCompressor().compress("\n".join(lines).encode()))
        elif i % 3 == 1:
            path = tmp_path / f"{name}.gz"
            path.write_bytes(gzip.compress("\n".join(lines).encode()))
        else:
            path = put(tmp_path, name, lines)
        inputs.append(f"file://{path}" if i % 2 else str(path))
        want += [10 * i, 10 * i + 1]
    for k in range(2):
        (tmp_path / f"folder {k}").mkdir()
        put(tmp_path / f"folder {k}", "in.jsonl", [f'{{"a":{500 + k}}}'])
        inputs.insert(0, str(tmp_path / f"folder {k}"))
        want.insert(0, 500 + k)
    inputs += [inputs[7], put(tmp_path, "b?.jsonl", ['{"a":900}'])]  # again, and a name that Spark would take for a pattern
    want += [50, 51, 900]
    cfg = Config(tuple(inputs), print_schema=True)
    df = to_dataframe(spark, cfg)
    assert sorted(r.a for r in df.collect()) == sorted(want)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 3
    errors = rows(collect_errors(spark, cfg))
    assert sorted(e[0] for e in errors) == list(range(4, 41, 3))
    out = tmp_path / "out.parquet"
    convert(spark, Config(tuple(inputs), output_path=str(out), single_file=True))
    assert pq.read_table(out)["a"].to_pylist() == want


def test_over_long_lines_and_zstd(spark, tmp_path):
    import zstandard

    src = tmp_path / "z.jsonl.zst"
    src.write_bytes(zstandard.ZstdCompressor().compress('{"a":"é"}\n{"a":"ééééééééé"}\n{"a":"y"}\r\n'.encode()))
    cfg = Config((str(src),), print_schema=True, max_line_bytes=11, on_error="collect")
    assert sorted(rows(to_dataframe(spark, cfg))) == [("y",), ("é",)]
    assert rows(collect_errors(spark, cfg)) == [(2, "invalid JSON", '{"a":"éé')]


def test_missing_inputs(spark, tmp_path):
    cfg = Config((str(tmp_path / "none"), put(tmp_path, "m.jsonl", ['{"a":1}'])), print_schema=True, missing_ok=True)
    assert rows(to_dataframe(spark, cfg)) == [(1,)]


def test_repeated_keys_after_the_sample(spark, tmp_path):
    lines = ['{"a":1,"o":{"p":1}}'] * 5 + ['{"a":2,"a":3,"o":{"p":4,"p":5}}', '{"a" :6, "a" : 7}', '{"a":null,"x":"\\":"}']
    src = put(tmp_path, "k.jsonl", lines)
    for more in ({}, {"threads": 2}, {"infer_scope": "full"}):
        df = to_dataframe(spark, Config((src,), print_schema=True, sample_lines=2, **more))
        assert [tuple(x)[:2] for x in rows(df)][5:] == [(2, 4), (6, None), (None, None)]
