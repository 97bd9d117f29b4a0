import datetime
import itertools
import random

import pytest

from millrace.cli import UsageError, main, parse_args
from millrace.functions.jsonwalk import BadLine, leaves, parse_object, wrap_int
from millrace.functions.timestamps import timestamp_micros_py
from millrace.operators.infer import infer_lines
from millrace.operators.nested import infer_tree, unify
from millrace.plans.config import ColumnSchema, Config, ConvertStats, InferredSchema, LogicalType, ParseError, PipelineState, Projection, TypeConflict
from millrace.plans.schema import TypeConflictError, apply_projection, merge_override, resolve_types
from millrace.plans.schema_json import parse_schema_json, write_schema_json

T = LogicalType
CFG = Config(("x",), print_schema=True)
SHIP = InferredSchema((ColumnSchema("hull", T.STRING), ColumnSchema("draft_m", T.DOUBLE), ColumnSchema("crew", T.INT64), ColumnSchema("left", T.TIMESTAMP, True, "trip.left")))


@pytest.mark.parametrize("policy", list(TypeConflict))
def test_resolve_every_set(policy):
    for n in range(len(T) + 1):
        for kinds in itertools.combinations(T, n):
            real = set(kinds) - {T.NULL}
            if len(real) < 2:
                want = next(iter(real), T.NULL)
            elif policy is TypeConflict.ERROR:
                with pytest.raises(TypeConflictError):
                    resolve_types(kinds, policy)
                continue
            else:
                want = T.DOUBLE if policy is TypeConflict.WIDEN and real == {T.INT64, T.DOUBLE} else T.STRING
            assert resolve_types(kinds, policy) is want


def test_timestamps_against_datetime():
    r, epoch = random.Random(6), datetime.datetime(1970, 1, 1)
    for _ in range(500):
        t = datetime.datetime(r.randint(1, 9999), r.randint(1, 12), r.randint(1, 28), r.randint(0, 23), r.randint(0, 59), r.randint(0, 59), r.choice([0, r.randint(0, 999_999)]))
        text = t.isoformat().replace("+00:00", "") + r.choice(["", "Z", "+05:30", " and more"])
        assert timestamp_micros_py(text) == (t - epoch) // datetime.timedelta(microseconds=1)


@pytest.mark.parametrize("text", ["", "noon", "2031-04-05", "2031-04-05 06:07:08", "2031-00-05T06:07:08", "2031-04-32T06:07:08", "2031-04-05T24:00:00", "2031-04-05T06:60:00", "2031-04-05T06:07:61"])
def test_no_timestamp(text):
    assert timestamp_micros_py(text) is None


def test_odd_timestamps():
    at = timestamp_micros_py
    assert at("2031-04-31T06:07:08Z") == at("2031-05-01T06:07:08Z")  # days roll over
    assert at("2031-04-05T06:07:60") == at("2031-04-05T06:08:00")
    assert at("2031-04-05T06:07:08.1234569") == at("2031-04-05T06:07:08.123456")
    assert at(" 2031-4-5T6:7:8") == at("2031-04-05T06:07:08")


def test_projection():
    names = lambda **k: [c.name for c in apply_projection(SHIP, Projection(**k)).columns]
    assert names(select=("left", "hull")) == ["left", "hull"]
    assert names(exclude=("crew", "mast")) == ["hull", "draft_m", "left"]
    assert names(select=("crew", "hull"), exclude=("hull",), rename=(("crew", "people"), ("people", "souls"))) == ["souls"]
    assert apply_projection(SHIP, Projection(rename=(("left", "sailed"),))).columns[3].json_path == "trip.left"
    for wrong in ({"select": ("mast",)}, {"rename": (("crew", "hull"),)}, {"select": ("crew", "crew")}):
        with pytest.raises(ValueError):
            names(**wrong)


def test_override():
    merged = merge_override(SHIP, [ColumnSchema("left", T.STRING, False), ColumnSchema("flag", T.BOOL, True, "papers.flag")])
    assert [(c.name, c.type, c.nullable, c.json_path) for c in merged.columns[3:]] == [("left", T.STRING, False, "trip.left"), ("flag", T.BOOL, True, "papers.flag")]
    assert merged.columns[:3] == SHIP.columns[:3]


def test_schema_json():
    text = write_schema_json(SHIP)
    assert parse_schema_json(text) == SHIP and "\n" not in text
    quoted = InferredSchema((ColumnSchema('a"\\b\u00e9', T.INT64),))
    assert parse_schema_json(write_schema_json(quoted)) == quoted
    column = '{"name":"hull","type":"string"}'
    for wrong in ("", "7", '{"columns":{}}', '{"columns":[7]}', '{"columns":[{"type":"bool"}]}', '{"columns":[{"name":"hull","type":"text"}]}', f'{{"columns":[{column},{column}]}}'):
        with pytest.raises(ValueError):
            parse_schema_json(wrong)


WRONG = [
    lambda: Config(()), lambda: Config(("in",)), lambda: Config(("in",), "out", batch_rows=0), lambda: Config(("in",), "out", threads=0), lambda: Config(("in",), "out", nested="native", output_format="columnar-raw"),
    lambda: Config(("in",), "out", raw_json="x"), lambda: Config(("in",), "out", dump_magic=b"1"), lambda: ColumnSchema("", T.INT64), lambda: ParseError(0, "why", ""), lambda: ParseError(3, "", ""), lambda: ConvertStats(rows_read=-1),
]


@pytest.mark.parametrize("make", WRONG)
def test_values_check_themselves(make):
    with pytest.raises(ValueError):
        make()


def test_values():
    c = Config(("in",), "out")
    assert (c.compression.value, c.batch_rows, c.on_error.value) == ("zstd", 65536, "skip")
    assert ConvertStats(final_state=PipelineState.DONE).exit_code == 0 and ConvertStats(final_state=PipelineState.ABORTED).exit_code == 4
    assert ConvertStats(5, 4, 1, 0, 9, 2).line() == "rows_read=5 rows_written=4 rows_skipped=1 bytes_out=9 elapsed_ms=2"


def test_walk():
    got = leaves(parse_object('{"k":7,"k":8,"p":{"q":{"r":{"s":{"t":0}}}},"w":[3, 4],"v":null,"o":{},"at":"2031-04-05T06:07:08Z","d":3.0}'))
    assert {k: v[0] for k, v in got.items()} == {"k": T.INT64, "p.q.r.s": T.STRING, "w": T.STRING, "v": T.NULL, "at": T.TIMESTAMP, "d": T.DOUBLE}
    assert got["p.q.r.s"][1] == '{"t":0}'
    assert got["k"][1] == 7 and got["w"][1] == "[3,4]"
    for wrong in ("0", '"x"', "[{}]", "{", '{"k":Infinity}', '{"k":1},', '{"":0}', '{"k":1}{"k":2}'):
        with pytest.raises(BadLine):
            parse_object(wrong)
    assert (wrap_int(2**64 - 5), wrap_int(2**64 + 5), wrap_int(-(2**63)), wrap_int(-(2**63) - 1)) == (-5, None, -(2**63), None)


def test_inference():
    s = infer_lines(['{"mast":2,"name":"Ida"}', "]", '{"name":3,"mast":2.5,"owner":null}', "{}"], CFG)
    assert [(c.name, c.type) for c in s.columns] == [("mast", T.DOUBLE), ("name", T.STRING), ("owner", T.NULL)] and s.sampled_rows == 3 and s.had_conflicts
    mixed = ['{"mast":true}', '{"mast":2}']
    assert infer_lines(mixed, Config(("x",), print_schema=True, type_conflict="error")).columns[0].type is T.STRING
    with pytest.raises(TypeConflictError):
        infer_lines(mixed, Config(("x",), print_schema=True, type_conflict="error", strict_sample_errors=True))


def test_nested_tree():
    tree = infer_tree(['{"n":4,"hold":{"coal":1},"log":[1]}', '{"n":4.5,"hold":{"coal":2,"tea":"x"},"log":[null,2.5]}', "7"])
    assert tree == {"n": "double", "hold": {"coal": "int", "tea": "string"}, "log": ["double"]}
    assert unify({"coal": "int"}, ["int"]) == "string" and unify("null", {"tea": "bool"}) == {"tea": "bool"}


def test_arguments():
    c = parse_args(["one", "-", "-o", "out", "--rename", "p=q", "--rename", "r=s,t=u", "--select", "k", "--select", "l,m", "--threads", "3", "--stats"])
    assert c.inputs == ("one", "-") and c.projection == Projection(("l", "m"), (), (("p", "q"), ("r", "s"), ("t", "u"))) and c.threads == 3 and c.emit_stats
    for wrong in (["one", "-o"], ["one", "--what"], ["one"], [], ["one", "-o", "x", "--format", "orc"], ["one", "-o", "x", "--rename", "pq"], ["one", "-o", "x", "--threads", "few"], ["one", "--format=parquet", "-o", "x"]):
        with pytest.raises(UsageError):
            parse_args(wrong)


def test_exit_codes(spark, tmp_path, capsys):
    assert main(["--help"]) == 0 and main(["x", "--what", "--version"]) == 0 and main(["--what"]) == 2
    src = tmp_path / "in.jsonl"
    src.write_text('{"k":1}\nno\n')
    assert main([str(src), "--print-schema"]) == 0 and '"name":"k"' in capsys.readouterr().out
    assert main([str(src), "-o", str(tmp_path / "out"), "--stats"]) == 0
    for failing in (["--select", "gone", "-o", "x"], ["--on-error", "abort", "-o", str(tmp_path / "none")], ["--select", "gone", "--print-schema"]):
        capsys.readouterr()
        assert main([str(src), *failing]) == 4
        said = capsys.readouterr().err.strip().splitlines()
        assert len(said) == 1 and said[0].startswith("error: ")
    assert main([str(tmp_path / "missing"), "-o", str(tmp_path / "y")]) == 4
