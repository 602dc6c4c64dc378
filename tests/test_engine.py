import random

import pytest
from pyspark.sql import functions as F

from tidewake.errors import FormatError, StatementError
from tidewake.functions import formatter
from tidewake.functions.syslog import FACILITIES, cut_bytes, facility, severity, syslog_line
from tidewake.model.schema import LOG_SCHEMA
from tidewake.operators import merge, sliding, truncate
from tidewake.plans.engine import Engine, decode_token, encode_token


def frame(spark, runs):
    """Records of several partitions, each a list of times in append order."""
    rows = [(s, s, {"p": s}, k // 3, k, t, f"{s}{k}", []) for s, times in runs.items() for k, t in enumerate(times)]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def merged(runs, backward=False):
    """Head by head merge of the runs."""
    heads = {s: list(reversed(t)) if backward else list(t) for s, t in runs.items()}
    out = []
    while any(heads.values()):
        live = sorted(s for s in heads if heads[s])
        s = (max if backward else min)(live, key=lambda s: heads[s][0])
        s = next(x for x in live if heads[x][0] == heads[s][0])
        out.append((s, heads[s].pop(0)))
    return out


@pytest.mark.parametrize("backward", [False, True])
def test_merge_is_that_of_heads(spark, backward):
    rng = random.Random(5)
    runs = {s: [rng.randint(0, 30) for _ in range(rng.randint(0, 12))] for s in "abcde"}
    got = merge.window(merge.with_merge_key(frame(spark, runs), backward=backward), backward=backward).collect()
    assert [(r["src"], r["ts_ns"]) for r in got] == merged(runs, backward)


def test_pages_cover_everything(spark):
    engine = Engine(spark)
    runs = {"a": [1, 5, 3, 9], "b": [2, 2, 8], "c": []}
    engine.register_view("v", frame(spark, runs))
    seen, token = [], None
    for _ in range(5):
        rows, token = engine.page("select", token, 2, view="v")
        seen += [(r["src"], r["ts_ns"]) for r in rows]
    assert seen == merged(runs)
    assert decode_token(encode_token({"a": (1, 2)})) == {"a": (1, 2)} and decode_token("TAIL") == "tail"
    with pytest.raises(StatementError):
        decode_token("???")


def test_offsets_and_limits(spark):
    engine = Engine(spark)
    engine.register_view("v", frame(spark, {"a": list(range(20))}), monotonic=True)
    times = lambda q, **k: [r["ts_ns"] for r in engine.sql(q, view="v", **k).collect()]
    assert times("select position tail offset -3") == [17, 18, 19]
    assert times("select position tail offset -100 limit 2") == [0, 1]
    assert times("select offset 5 limit 3") == [5, 6, 7]
    assert times("select limit 0") == []
    assert times("select limit -1") == list(range(20))
    assert times("select where msg suffix 5 or ts > 18") == [5, 15, 19]
    with pytest.raises(StatementError):
        engine.sql("select", view="v", limit=-1)


def test_many_positions(spark, monkeypatch):
    runs = {s: [1, 2, 3, 4] for s in "abcd"}
    keyed = merge.with_merge_key(frame(spark, runs), True)
    position = {"a": (0, 2), "b": (1, 3), "x": (9, 9)}
    take = lambda: [(r["src"], r["ts_ns"]) for r in merge.window(keyed, position, -2, 6).collect()]
    spelled = take()
    monkeypatch.setattr(merge, "MOST_LITERALS", 1)
    assert take() == spelled and len(spelled) == 6


def test_range_is_inclusive_and_reaches_the_scan(spark, tmp_path):
    engine = Engine(spark)
    path = str(tmp_path / "log")
    frame(spark, {"a": [1, 2, 3, 4, 5]}).write.parquet(path)
    engine.register_view("v", spark.read.parquet(path), monotonic=True)
    out = engine.sql('select range ["2":"4"] where msg contains a', view="v")
    assert [r["ts_ns"] for r in out.collect()] == [2, 3, 4]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts_ns,2)" in plan and "LessThanOrEqual(ts_ns,4)" in plan and "StringContains(msg,a)" in plan


def test_templates(spark):
    ns = 1_549_448_569_201_168_034  # 2019-02-06 10:22:49.201168034
    row = spark.createDataFrame([("s", "a=bbb,b=ddd", {"a": "bbb", "b": "ddd"}, 0, 0, ns, '\test" message\n', [("field1", "value1"), ("field2", "x,y"), ("field1", "other")])], LOG_SCHEMA)
    cases = {
        "AAA": "AAA", "{Msg}": '\test" message\n', "{Msg.Json()}": '"\\test\\" message\\n"', "{Msg}|{VaRS}": '\test" message\n|a=bbb,b=ddd,field1=value1,field2="x,y",field1=other', "{TS.format(3:04PM)}": "10:22AM", "{tS.Format()}": "",
        "{vars:field1}{vars:a}{vars:none}": "value1bbb", "{ts}": "2019-02-06T10:22:49Z", "{{x{}": "{x}", "{ts.format(Monday, 02-Jan-06 15:04:05.999999999 MST)}": "Wednesday, 06-Feb-19 10:22:49.201168034 UTC", "{ts.format(_2 1 .000)}": " 6 2 .000",
    }
    got = row.select(*(formatter.render(t).alias(f"c{k}") for k, t in enumerate(cases))).first()
    assert list(got) == list(cases.values())
    berlin = row.select(formatter.render("{ts.format(2006-01-02T15:04:05.000Z07:00)}", "Europe/Berlin")).first()[0]
    assert berlin == "2019-02-06T11:22:49.201+01:00"


@pytest.mark.parametrize("template", ["{asdf}", "{Message}", "{Msg.}", "{Msg.json)}", "{ts.}", "{ts.format(}", "{Messa", "{tags:}", "{tag:___", "{a{b}}"])
def test_bad_templates(template):
    with pytest.raises(FormatError):
        formatter.parse(template)


def test_json_escapes(spark):
    import json

    texts = ["", '"', 'ha\\\r"haЛw\x19', " \"\nЫ\t\x00<&>", "\x1f\x7f"]
    rows = spark.createDataFrame([(t,) for t in texts], "msg string")
    for t, r in zip(texts, rows.select(formatter.json_text(F.col("msg")).alias("j")).collect(), strict=True):
        assert r["j"] == json.dumps(t, ensure_ascii=False).replace("\\b", "\\u0008").replace("\\f", "\\u000c")


def test_cut_is_that_of_brute_force(spark):
    texts = ["aé日😀" * k + "x" * j for k in range(0, 12, 3) for j in range(4)] + ["日" * 90, "😀" * 60, "", "é" * 101 + "a" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    limits = [1, 2, 3, 4, 5, 9, 30, 200]
    got = {r["k"]: r for r in rows.select("k", *(cut_bytes(F.col("t"), n).alias(f"c{n}") for n in limits)).collect()}
    for k, t in enumerate(texts):
        for n in limits:
            raw = t.encode()
            assert got[k][f"c{n}"] == (t if len(raw) <= n else raw[:n].decode("utf-8", "ignore") + "... [truncated]\n"), (t, n)


def test_syslog_documents_are_cut(spark, sf_dir):
    from tidewake.plans import registry

    texts = {r["doc_id"]: r["text"].replace("\n", "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    lines = {r["ts_ns"]: r["line"].split(" - - - ", 1)[1] for r in registry.QUERIES["syslog_documents"](spark, sf_dir).collect()}
    assert lines == {d: t if len(t.encode()) <= 200 else t.encode()[:200].decode("utf-8", "ignore") + "... [truncated]\n" for d, t in texts.items()}
    assert sum(x.endswith("... [truncated]\n") for x in lines.values()) > len(lines) / 2


def test_syslog(spark):
    row = spark.createDataFrame([("s", "a=b", {"a": "b"}, 0, 0, 1_500_000, "line\nfeed äöü", [("sev", "crit")])], LOG_SCHEMA)
    line = lambda **k: row.select(syslog_line(**k)).first()[0]
    assert line() == "<182>1 1970-01-01T00:00:00.0015Z localhost a=b - - - linefeed äöü"
    assert line(severity="{vars:sev}", facility="kern", hostname="h", tags="t", msg="{vars:a}") == "<2>1 1970-01-01T00:00:00.0015Z h t - - - b"
    assert line(severity="{vars:none}", limit=10).endswith("linefeed ... [truncated]\n")
    assert line(limit=11).endswith("linefeed ä... [truncated]\n") and line(replace_newlines=False, limit=4).endswith("line... [truncated]\n")
    assert facility("local7") == 23 << 3 and severity("debug") == 7 and len(FACILITIES) == 24
    with pytest.raises(ValueError):
        severity("none")


def chunk_frame(spark):
    rows = [("a", "a", 1, 10, 100, 0, 10), ("a", "a", 2, 10, 100, 5, 30), ("a", "a", 3, 10, 100, 0, 20), ("b", "b", 1, 5, 50, 0, 5)]
    return spark.createDataFrame(rows, "src string, tag_line string, chunk_id long, records long, bytes long, min_ts_ns long, max_ts_ns long")


@pytest.mark.parametrize(
    "given,dropped",
    [({"max_size": 250}, {("a", 1)}), ({"max_size": 150}, {("a", 1), ("a", 2)}), ({"max_size": 150, "min_size": 120}, {("a", 1)}), ({"max_size": 100, "min_size": 100}, set()), ({"before_ns": 20}, {("a", 1), ("b", 1)}), ({"before_ns": 30, "min_size": 1}, {("a", 1), ("a", 2)}), ({"max_size": 250, "before_ns": 30}, {("a", 1), ("a", 2), ("a", 3), ("b", 1)}), ({}, set())],
)
def test_truncation_by_chunk(spark, given, dropped):
    rows = truncate.chunk_plan(chunk_frame(spark), **given).filter("dropped").collect()
    assert {(r["src"], r["chunk_id"]) for r in rows} == dropped


def test_truncation_of_the_whole(spark):
    planned = truncate.chunk_plan(chunk_frame(spark))
    assert [r["src"] for r in truncate.partition_plan(planned, 100).collect()] == ["a"]
    assert {r["src"] for r in truncate.partition_plan(planned, 320, oldest_first=True).collect()} == {"b"}
    assert {r["src"] for r in truncate.partition_plan(planned, 0).collect()} == {"a", "b"}
    assert truncate.partition_plan(planned, 350).count() == 0


def test_sliding_totals(spark):
    rows = spark.createDataFrame([("x", t, v) for t, v in [(0, 1), (5, 2), (12, 4), (31, 8)]], "k string, ts_ns long, v long")
    got = {r["bucket_ns"]: (r["bucket_total"], r["total"]) for r in sliding.sliding_total(rows, ["k"], F.col("v"), 20, 10).collect()}
    assert got == {0: (3, 3), 10: (4, 7), 30: (8, 8)}
