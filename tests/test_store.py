import io
import os
import random
import socketserver
import threading
import time

import pytest

from tidewake.errors import StatementError
from tidewake.plans.engine import Engine
from tidewake.sinks.stdout import Stdout
from tidewake.sinks.syslog import Syslog, Target
from tidewake.sources import parsers
from tidewake.sources.collector import Collector, PathSchema


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


def records(spark, times, prefix="m"):
    return spark.createDataFrame([(t, f"{prefix}{t}") for t in times], "ts_ns long, msg string").coalesce(1)


def lines(df):
    return [r["msg"] for r in df.collect()]


def test_write_and_select(spark, engine):
    assert engine.sql("select").count() == 0 and engine.execute("show partitions").count() == 0
    engine.write("app=a", "host=h", records(spark, [1, 5, 3]))
    engine.write("app=b,env=x", "", records(spark, [2, 4], "n"))
    engine.write("{app=a}", "", records(spark, [6], "o"))
    assert lines(engine.sql("select")) == ["m1", "n2", "n4", "m5", "m3", "o6"]
    assert lines(engine.sql("select from {app=a} where fields:host = h")) == ["m1", "m5", "m3"]
    assert lines(engine.sql("select from env=x")) == ["n2", "n4"]
    assert [r["line"] for r in engine.sql('select "{vars}" from app=b limit 1').collect()] == ["app=b,env=x"]
    shown = engine.execute("show partitions").collect()
    assert [(r["tag_line"], r["records"], r["total_records"], r["total_partitions"]) for r in shown] == [("app=a", 4, 6, 2), ("app=b,env=x", 2, 6, 2)]
    assert [r["records"] for r in engine.execute("describe partition {app=a}").collect()] == [3, 1]
    with pytest.raises(ValueError):
        engine.write("", "", records(spark, [1]))
    with pytest.raises(ValueError):
        Engine(spark, engine.store.root, max_sources=2).sql("select")


def test_field_texts(spark, engine):
    rows = spark.createDataFrame([(1, "a", 'x=1,y="2,3"'), (2, "b", "not fields"), (3, "c", None)], "ts_ns long, msg string, fields string").coalesce(1)
    engine.write("app=a", "host=h", rows)
    assert [r["fields_line"] for r in engine.sql("select").collect()] == ['host=h,x=1,y="2,3"', "host=h", "host=h"]


def test_truncate(spark, engine):
    for t in ([1, 2], [3, 4], [5, 6]):
        engine.write("app=a", "", records(spark, t))
    engine.write("app=b", "", records(spark, [9]))
    dry = engine.execute("truncate dryrun before '4'").collect()
    assert [(r["tag_line"], r["chunks_dropped"], r["deleted"]) for r in dry] == [("app=a", 2, False)]
    assert engine.sql("select").count() == 7
    engine.execute("truncate before '4'")
    assert lines(engine.sql("select")) == ["m5", "m6", "m9"]
    done = engine.execute("truncate maxdbsize 29").collect()
    assert [(r["tag_line"], r["deleted"]) for r in done] == [("app=b", True)] and lines(engine.sql("select")) == ["m5", "m6"]
    assert [r["tag_line"] for r in engine.execute("show partitions").collect()] == ["app=a"]


def test_pipes(spark, engine):
    engine.write("app=a", "", records(spark, [1, 2]))
    engine.execute("create pipe old from {app=a} where msg contains m")
    engine.execute("create pipe p from app=a where msg suffix 3 or msg suffix 4")
    with pytest.raises(StatementError):
        engine.execute("create pipe p")
    assert engine.pipes.ensure("p", "app=a", "msg suffix 3 or msg suffix 4").first()["name"] == "p"
    with pytest.raises(StatementError):
        engine.pipes.ensure("p", "app=b")
    engine.write("app=a,x=1", "f=1", records(spark, [3, 5]))
    engine.pipes.start("p").awaitTermination()
    assert lines(engine.sql("select from {stream.pipe=p}")) == ["m3"]
    assert engine.sql("select from {stream.pipe=p}").first()["fields_line"] == "f=1,app=a,x=1"
    engine.write("app=a", "", records(spark, [4]))
    engine.pipes.start("p").awaitTermination()
    engine.pipes.start("p").awaitTermination()
    assert lines(engine.sql("select from {stream.pipe=p}")) == ["m3", "m4"]
    # What pipes write goes into no pipe.
    engine.execute("create pipe all")
    engine.write("app=c", "", records(spark, [7]))
    engine.pipes.start("p").awaitTermination()
    engine.pipes.start("all").awaitTermination()
    assert lines(engine.sql("select from {stream.pipe=all}")) == ["m7"]
    assert [r["name"] for r in engine.execute("show pipes").collect()] == ["all", "old", "p"]
    assert [r["name"] for r in engine.execute("show pipes offset 1 limit 1").collect()] == ["old"]
    assert engine.execute("describe pipe p").first()["dest_tag_line"] == "stream.pipe=p"
    engine.execute("delete pipe p")
    assert lines(engine.sql("select from {stream.pipe=p}")) == ["m3", "m4"]
    with pytest.raises(StatementError):
        engine.execute("describe pipe p")


def test_tail_and_forward(spark, engine, tmp_path):
    got = []
    engine.write("app=a", "", records(spark, [1, 2]))
    follow = lambda: engine.tail("select where msg contains m", lambda df: got.extend(lines(df)), str(tmp_path / "tail")).awaitTermination()
    follow()
    engine.write("app=new", "", records(spark, [4, 3]))
    follow()
    follow()
    assert got == ["m1", "m2", "m4", "m3"]
    engine.execute("create pipe f")
    engine.write("app=a", "", records(spark, [8]))
    engine.pipes.start("f").awaitTermination()
    out = io.StringIO()
    engine.forward("f", Stdout(out), str(tmp_path / "fwd")).awaitTermination()
    assert out.getvalue() == "m8\n"


def test_syslog_transport(spark, engine):
    heard = []

    class Handler(socketserver.StreamRequestHandler):
        def handle(self):
            heard.extend(self.rfile.read().decode().splitlines())

    with socketserver.ThreadingTCPServer(("127.0.0.1", 0), Handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        engine.write("app=a", "", records(spark, [1, 2]))
        Syslog(Target("tcp", f"127.0.0.1:{server.server_address[1]}"))(engine.rows("select"))
        server.shutdown()
    assert [x.split(" - - - ")[1] for x in heard] == ["m1", "m2"]
    with pytest.raises(ValueError):
        Target("smtp")


def test_collector(spark, engine, tmp_path):
    logs = tmp_path / "logs"
    (logs / "svc").mkdir(parents=True)
    (logs / "svc" / "one.log").write_text("2024-01-02 03:04:05 first\n  more of it\nlast without end")
    (logs / "svc" / "skip.gz.log").write_text("x\n")
    (logs / "k8.json").write_text('{"log":"hi\\n","stream":"stderr","time":"2023-09-08T07:06:05.040302010Z"}\nnot json\n')
    schemas = [PathSchema(r"/(?P<dir>\w+)/(?P<name>\w+)\.log$", {"app": "{dir}", "file": "t-{name}"}, {"note": "n"}, "text"), PathSchema(r"k8\.json$", {"app": "k8"}, {}, "k8json")]
    collector = Collector([str(logs / "*" / "*.log"), str(logs / "*.json")], schemas, [r"\.gz\.log$"])
    rows = {r["msg"]: r for r in collector.read(collector.lines(spark)).collect() if r["msg"] is not None}
    assert set(rows) == {"2024-01-02 03:04:05 first\n", "  more of it\n", "last without end", "hi\n"}
    assert len({rows[m]["ts_ns"] for m in rows if m != "hi\n"}) == 1 and rows["hi\n"]["ts_ns"] == 1694156765040302010
    assert rows["  more of it\n"]["tag_line"] == "app=svc,file=t-one" and rows["hi\n"]["fields_kv"][0]["v"] == "stderr"
    bad = collector.read(collector.lines(spark)).filter("corrupt is not null").collect()
    assert [r["corrupt"] for r in bad] == ["not json\n"]
    stream = Collector([str(logs / "svc")], schemas, [r"\.gz\.log$"])
    for _ in range(2):
        engine.collect(stream, str(tmp_path / "cp")).awaitTermination()
    assert lines(engine.sql("select")) == ["2024-01-02 03:04:05 first\n", "  more of it\n"]  # the last line waits for its end
    engine.collect(stream, str(tmp_path / "cp"), idle=0).awaitTermination()
    assert lines(engine.sql("select"))[2] == "last without end"
    long = Collector([str(logs / "svc" / "one.log")], schemas, max_line=10)
    assert "".join(r["line"] for r in long.lines(spark).orderBy("line_no").collect()) == (logs / "svc" / "one.log").read_text()


def test_collecting_goes_on(spark, engine, tmp_path):
    one, two = tmp_path / "a" / "one.log", tmp_path / "b[1]" / "two.txt"
    for f in (one, two):
        f.parent.mkdir()
    collector = Collector([str(tmp_path / "a" / "*.log"), str(tmp_path / "b*" / "*.txt"), str(tmp_path / "none" / "*"), str(tmp_path / "*" / "one.log")], [PathSchema(r"/(?P<n>\w+)\.\w+$", {"f": "{n}"})], [r"gone"])

    def taken():
        engine.collect(collector, str(tmp_path / "cp")).awaitTermination()
        return {t: "".join(lines(engine.sql(f"select from f={t}"))) for t in ("one", "two")}

    one.write_text("1\n")
    two.write_text("a\n")
    assert taken() == {"one": "1\n", "two": "a\n"} == taken()
    # Grown, in the middle of a line and of a character: whole lines are taken.
    with one.open("ab") as f:
        f.write("2\nthr日".encode()[:-1])
    assert taken() == {"one": "1\n2\n", "two": "a\n"}
    with one.open("ab") as f:
        f.write("日".encode()[-1:] + b"ee\n")
    assert taken() == {"one": "1\n2\nthr日ee\n", "two": "a\n"}
    # Rewritten in place: of the same length, longer; rotated; shorter.
    for text in ("b\n", "cc\ndd\n"):
        two.write_text(text)
        assert taken()["two"].endswith(text)
    two.rename(two.with_suffix(".old"))
    two.write_text("e\n")
    assert taken() == {"one": "1\n2\nthr日ee\n", "two": "a\nb\ncc\ndd\ne\n"}
    # A batch that comes again takes the same bytes and replaces its chunk; order is that of the batches, whoever else writes.
    engine.write("f=one", "", spark.createDataFrame([(time.time_ns(), "between\n")], "ts_ns long, msg string"))
    with one.open("a") as f:
        f.write("last\n")
    append, engine.store.append = engine.store.append, lambda *a, **k: 1 / 0
    with pytest.raises(Exception):  # noqa: B017
        taken()
    engine.store.append = append
    with one.open("a") as f:
        f.write("more\n")
    taken()
    assert taken()["one"] == "1\n2\nthr日ee\nbetween\nlast\nmore\n"


def test_lines_of_byte_ranges():
    from tidewake.sources import files

    text = ("short\n" + "é" * 40 + "\n\n" + "x" * 25 + "\nno end").encode()
    for limit in (10, 11, 16, 1000):
        got = list(files.lines_of(io.BytesIO(text), 0, len(text), limit))
        assert b"".join(x for _, x in got) == text and [at for at, _ in got] == [sum(len(x) for _, x in got[:k]) for k in range(len(got))]
        assert all(0 < len(x) <= limit and x.decode() for _, x in got) and (limit < 1000 or len(got) == 5)
    assert files.whole_lines(io.BytesIO(text), len(text), 1000) == len(text) - 6
    assert files.whole_lines(io.BytesIO(b"y" * 50), 50, 20) == 50 and files.whole_lines(io.BytesIO(b"y" * 15), 15, 20) == 0
    assert [files.local(p) for p in ("/a/b", "file:/a/b", "file:///a/b", "hdfs://h/a")] == ["/a/b", "/a/b", "/a/b", None]


def test_ranges_of_a_file_cut_no_line():
    from tidewake.sources import files

    rng = random.Random(3)
    text = b"".join(b"z" * rng.choice([0, 1, 5, 40, 40000]) + b"\n" for _ in range(60)) + b"no end"
    for start, end in ((0, len(text)), (text.index(b"\n") + 1, len(text) - 6), (0, 0)):
        whole = list(files.lines_of(io.BytesIO(text), start, end, 1000))
        for size in (1, 7, 1000, 100_000, 1 << 30):
            ranges = files.cuts(io.BytesIO(text), start, end, size)
            assert [x for r in ranges for x in files.lines_of(io.BytesIO(text), *r, 1000)] == whole
            assert size > 1000 or end == 0 or len(ranges) > 10


def test_logfmt(spark):
    def one(log, keys, time="2023-09-08T07:06:05Z"):
        import json

        rows = spark.createDataFrame([("f", 0, json.dumps({"log": log, "stream": "s", "time": time}))], "file string, line_no long, line string")
        r = parsers.parse_logfmt(rows, keys).first()
        return r["ts_ns"], [(f["k"], f["v"]) for f in r["fields_kv"]]

    assert one("", ["a"])[1] == [("stream", "s")]
    assert one('a=1 b="x y" c', ["a", "b", "c"])[1] == [("stream", "s"), ("a", "1"), ("b", "x y"), ("c", "")]
    assert one('b="a=9" a=2 a=3', ["a"])[1] == [("stream", "s"), ("a", "3")]
    assert one('a="open', ["a"])[1] == [("stream", "s")]
    assert one("time=2023-09-08T07:06:06.5Z", ["time"])[0] == 1694156766500000000
    assert one("time=bad", ["time"]) == (1694156765000000000, [("stream", "s"), ("time", "bad")])


def test_parser_configuration():
    with pytest.raises(ValueError):
        parsers.parser("csv")
    with pytest.raises(ValueError):
        parsers.parser("pure", ["YYYY"])


def test_dates_skip_and_come_back(spark):
    finder = parsers.DateFinder()
    state = parsers.DatedLines(finder)
    for _ in range(10):
        assert state.date("nothing") is None
    assert state.skipping
    for _ in range(10):
        assert state.date("2024-01-01 00:00:00") is None
    assert not state.skipping and state.date("2024-01-01 00:00:00") is not None
    text = spark.createDataFrame([("f", k, x) for k, x in enumerate(["2024-01-01 00:00:00 a", "b", "2024-01-01 00:00:01 c"])], "file string, line_no long, line string")
    assert {r["pattern"]: r["hits"] for r in parsers.date_statistics(text).collect()} == {"YYYY-MM-DD HH:mm:ss": 2, "": 1}


def test_dates_of_every_line_are_found(spark):
    undated = ["no date here"] * 10
    texts = [*undated, "2024-01-01 00:00:00 a", *undated * 3, "at [02/Jan/2024:00:00:00 +0000] b", *undated, "2024-01-03 00:00:00 c"]
    text = spark.createDataFrame([("f", k, x) for k, x in enumerate(texts)], "file string, line_no long, line string")
    day = 86400 * 10**9
    first = 1704067200 * 10**9
    expected = [None] * 10 + [first] * 31 + [first + day] * 11 + [first + 2 * day]
    assert [r["ts_ns"] for r in parsers.parse_text(text).orderBy("line_no").collect()] == expected
    assert {r["pattern"]: r["hits"] for r in parsers.date_statistics(text).collect()} == {"YYYY-MM-DD HH:mm:ss": 2, "DD/MMM/YYYY:HH:mm:ss ZZZZ": 1, "": 50}


def test_patterns_left_out_match_nothing():
    rng = random.Random(4)
    finder = parsers.DateFinder(["MMM", "YYYY_MM"])
    stems = ["2024-01-05 06:07:08", "05/Jan/2024:06:07:08 +0000", "Jan 5, 2024 6:07:08 PM", "Fri, 05 Jan 2024 06:07:08 GMT", "1.2.24", "2024-01-05T06:07:08.123Z", "May", "2024_03", "٢٠٢٤-٠١-٠٥", "x"]
    for _ in range(2000):
        line = "".join(c for c in rng.choice(stems) + rng.choice([" ", ""]) + rng.choice(stems) if rng.random() > 0.05)
        plain = next(((ns, p) for p in finder.patterns if (ns := p.find(line, finder.now)) is not None), None)
        assert finder.find(line) == plain


def test_append_writes_records_once(spark, engine, monkeypatch):
    from pyspark.sql import DataFrameWriter

    written, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), parquet(self, path, *a, **k))[1])
    engine.write("app=b,a=1", "f=1", records(spark, [1, 5, 3]))
    assert sorted(p.split("/")[-1] if "/staging/" not in p else "staging" for p in written) == ["chunks", "partitions", "staging"]
    row = engine.store.chunks().first()
    assert (row["records"], row["min_ts_ns"], row["max_ts_ns"], row["monotonic"]) == (3, 1, 5, False)
    assert row["bytes"] == engine.execute("show partitions").first()["size"] == 3 * (8 + 2 + 3)
    assert engine.store.partitions().first()["tags"] == {"a": "1", "app": "b"}
    # A repeated write replaces its own chunk.
    again = engine.rows("select").select("tags", "ts_ns", "msg", "fields_kv").filter("ts_ns < 5").localCheckpoint()
    engine.store.append(again, chunk_id=row["chunk_id"])
    assert sorted(lines(engine.sql("select"))) == ["m1", "m3"] and not engine.store.exists("staging/" + str(row["chunk_id"]))


def test_shell(spark, engine, capsys):
    from tidewake import cli

    engine.write("app=a", "", records(spark, [1, 2], "\nx"))
    out = io.StringIO()
    cli.run(engine, "select", out)
    assert out.getvalue() == "x1\nx2\n"
    out = io.StringIO()
    cli.run(engine, "select '{vars:app};' limit 1", out)
    cli.run(engine, "show partitions", out)
    assert out.getvalue().startswith("a;src\ttag_line")
    assert cli.main([engine.store.root, "selec"]) == 1 and "error" in capsys.readouterr().err


def test_writers_of_two_applications_take_turns(spark, tmp_path):
    from tidewake.plans.store import Lock, Store

    store, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    with store.lock, store.lock:
        assert store.exists("lock")
        waiting = Lock(other, patience=0.3)
        with pytest.raises(TimeoutError), waiting:
            pass
    assert not store.exists("lock")
    store.write_text("lock", "")  # left by an application that is gone
    os.utime(tmp_path / "s" / "lock", (time.time() - 100, time.time() - 100))
    with other.lock:
        assert other.exists("lock")
    assert not other.exists("lock")


def test_range_prunes_chunks_and_src_overrides_from(spark, engine):
    for t in ([1, 2], [30, 20], [50]):
        engine.write("app=a", "", records(spark, t))
    engine.write("app=b", "", records(spark, [21], "n"))
    rows = engine.rows("select range ['20':'30']")
    assert lines(rows) == ["n21", "m30", "m20"]
    filters = rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [", 1)[1].split("], PushedFilters")[0]
    chunks = {(r["min_ts_ns"], str(r["chunk_id"])) for r in engine.store.chunks().collect()}
    assert all((c in filters) == (t in (20, 21)) for t, c in chunks)
    src = {r["tag_line"]: r["src"] for r in engine.store.partitions().collect()}
    assert lines(engine.sql("select from app=a where msg contains 2", src=src["app=b"])) == ["n21"]
    got, token = engine.page("select", None, 2, src=src["app=a"])
    assert [r["msg"] for r in got] == ["m1", "m2"] and [r["msg"] for r in engine.page("select", token, 9, src=src["app=a"])[0]] == ["m30", "m20", "m50"]
    assert engine.store.table("partitions", "src string").count() == 2  # noted once, not for each write


def test_merge_over_blocks(spark):
    from tidewake.operators import merge, stats

    rng = random.Random(6)
    rows = [("s", "a=1", c, (b << 16) + k, rng.randint(0, 1000)) for c in range(3) for b in range(3) for k in range(20)]
    df = spark.createDataFrame(rows, "src string, tag_line string, chunk_id long, idx long, ts_ns long")
    for backward, best, turn in ((False, max, 1), (True, min, -1)):
        key, so_far = {}, None
        for r in rows[::turn]:
            so_far = r[4] if so_far is None else best(so_far, r[4])
            key[r[2], r[3]] = so_far
        assert {(r["chunk_id"], r["idx"]): r[merge.KEY] for r in merge.with_merge_key(df, False, backward).collect()} == key
    assert [r["monotonic"] for r in stats.monotonic(df).collect()] == [False] * 3
    rising = [("s", "a=1", 0, r[3], k) for k, r in enumerate(r for r in rows if r[2] == 0)]
    assert stats.monotonic(spark.createDataFrame(rising, df.schema)).first()["monotonic"]
    falling = [*rising[:20], *((*r[:4], 5) for r in rising[20:])]  # only from block to block
    assert not stats.monotonic(spark.createDataFrame(falling, df.schema)).first()["monotonic"]


def test_merge_backward_takes_each_row_once(spark):
    from tidewake.operators import merge

    df = spark.createDataFrame([], "src string, tag_line string, chunk_id long, idx long, ts_ns long")
    plan = merge.with_merge_key(df, False, True)._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("specifiedwindowframe(rowframe, unboundedpreceding") == 2 and "unboundedfollowing" not in plan


def test_shell_collects_and_forwards(spark, engine, tmp_path):
    import json

    from tidewake import cli

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "x.log").write_text("one\ntwo\n")
    workers = {"w": {"pipe": "twos", "source": "app=x", "where": "msg contains two", "sink": {"type": "stdout"}}}
    collecting = {"include": [str(tmp_path / "logs" / "*.log")], "schemas": [{"path": r"(?P<n>\w+)\.log$", "tags": {"app": "{n}"}}], "checkpoint": str(tmp_path / "cp")}
    forwarding = {"workers": workers, "checkpoints": str(tmp_path / "fwd")}
    out = io.StringIO()
    cli.forward(engine, forwarding | {"workers": {}}, out)
    engine.pipes.ensure("twos", "app=x", "msg contains two")
    (tmp_path / "c.json").write_text(json.dumps(collecting))
    assert cli.main([engine.store.root, "--collect", str(tmp_path / "c.json")]) == 0 and lines(engine.sql("select")) == ["one\n", "two\n"]
    cli.follow(engine, cli.forward(engine, forwarding, out))
    assert out.getvalue() == "two\n"
    assert cli.main([engine.store.root, "--stop"]) == 0 and engine.store.exists("stop")
    cli.follow(engine, [])
