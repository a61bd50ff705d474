"""Trail filters, many clauses, lookups, appends, the store, the command line and streams."""

import io

import pytest
from pyspark.sql import functions as F

from eventlane import cli, errors
from eventlane.operators import PageIndex, TrailFrame, append
from eventlane.plans.filters import EventFilter, parse
from eventlane.sources import open_frame, read_csv, write_frame
from eventlane.sources.store import stored_meta
from eventlane.streaming import append_batches, stream_sessions


def frame(spark, rows, kinds="k string, t long, s long, a string, b string"):
    return TrailFrame.of(spark.createDataFrame(rows, kinds), "k", "t", "s", ("a", "b"))


def test_many_clauses_of_every_kind(spark):
    rows = [(f"{i % 7:032x}", i, i, f"x{i % 5}", f"y{i % 3}") for i in range(60)]
    e = frame(spark, rows)
    f = EventFilter()
    kept = rows
    for i in range(400):
        f.new_clause() if i else None
        kind = i % 5
        if kind == 0:
            f.add_term("a", "x1").add_term("a", "x2").add_term("b", f"y{i}")
            kept = [r for r in kept if r[3] in ("x1", "x2") or r[4] == f"y{i}"]
        elif kind == 1:
            f.add_term("a", f"x{i}", True)
            kept = [r for r in kept if r[3] != f"x{i}"]
        elif kind == 2:
            f.add_time_range(i - 2, 1000).add_time_range(0, 50).add_term("nosuch", "z")
            kept = [r for r in kept if r[1] < 50 or r[1] >= i - 2]
        elif kind == 3:
            f.add_term("b", "y0", True).add_term("b", "y1", True).add_term("a", f"q{i}")
        else:
            f.add_term("nosuch", "z", True)
    assert sorted(r["seq"] for r in e.scan(f).collect()) == [r[2] for r in kept] and kept
    f.new_clause().add_term("nosuch", "z")
    assert e.scan(f).count() == 0
    one = EventFilter()
    for i in range(5000):
        one.add_term("a", f"v{i}")
    assert e.scan(one.add_term("a", "x3")).count() == 12


def test_appended_values_come_after_those_of_the_base(spark):
    base = frame(spark, [("k", 5, 10, "late", ""), ("k", 6, 11, "z", "")])
    more = append(base, frame(spark, [("k", 5, 0, "early", ""), ("k", 1, 1, "z", "")]))
    assert {r["value"]: r["val"] for r in more.lexicon().where("field = 1").collect()} == {"": 0, "late": 1, "z": 2, "early": 3}
    assert [r["a"] for r in more.trail("k").collect()] == ["z", "late", "early", "z"]


def test_lookups(spark):
    ks = ["01" + "0" * 30, "00" * 15 + "01", "ff" + "0" * 30]
    e = frame(spark, [(k, i, i, f"v{i}", "") for i, k in enumerate(ks)])
    ids = {r["trail_key"]: r["trail_id"] for r in e.trail_ids().collect()}
    assert {k: e.trail_id(k) for k in ks} == ids and e.trail_id(ks[2].upper()) == 1
    with pytest.raises(errors.UnknownKey):
        e.trail_id("ab" + "0" * 30)
    for bad in ("xy" * 16, "ab"):
        with pytest.raises(errors.InvalidKey):
            e.trail_id(bad)
    assert e.item_to_value(e.item("a", "v1")) == "v1"
    with pytest.raises(errors.NoSuchItem):
        e.item_to_value(256 * 99 + 1)
    view = e.with_filter(EventFilter().add_term("a", "v1"))
    e.close()
    with pytest.raises(errors.HandleClosed):
        view.scan()


def test_store_is_there_only_when_whole(spark, tmp_path):
    at = str(tmp_path / "db")
    with pytest.raises(errors.TimestampTooLarge):
        write_frame(frame(spark, [("k", 1, 1, "", ""), ("k", 1 << 47, 2, "", "")]), at)
    with pytest.raises(errors.NotFound):
        open_frame(spark, at)
    write_frame(frame(spark, [(f"{i % 50:032x}", i, i, f"x{i}", "") for i in range(500)]), at)
    m = stored_meta(spark, at)
    assert (m["num_trails"], m["num_events"], m["min_timestamp"], m["max_timestamp"]) == (50, 500, 0, 499)
    with pytest.raises(errors.OutputExists):
        write_frame(frame(spark, [("k", 1, 1, "", "")]), at)
    write_frame(frame(spark, []), str(tmp_path / "empty"))
    assert open_frame(spark, str(tmp_path / "empty")).scan().count() == 0


def test_index_prunes_by_pushed_key_ranges(spark, tmp_path):
    d = spark.createDataFrame([(i, i, i, f"x{i // 10}", "") for i in range(300)], "k long, t long, s long, a string, b string")
    write_frame(TrailFrame.of(d, "k", "t", "s", ("a", "b")), str(tmp_path / "db"))
    e = open_frame(spark, str(tmp_path / "db"))
    f = EventFilter().add_term("a", "x7").add_term("a", "x9")
    index = PageIndex.build(e, 60)
    got = index.scan(f)
    assert sorted(r["seq"] for r in got.collect()) == [*range(70, 80), *range(90, 100)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(trail_key" in plan and "Exchange" not in plan and len(index.ranges(f)) == 2
    assert index.ranges(EventFilter().add_term("a", "none")) == [] and index.scan(EventFilter().add_term("a", "none")).count() == 0


def test_command_line_pipes_and_finds_the_index(spark, tmp_path, capsys, monkeypatch):
    at = str(tmp_path / "db")
    monkeypatch.setattr("sys.stdin", io.StringIO("uuid time a\n" + "".join(f"{i:032x} {i} v{i % 3}\n" for i in range(30))))
    cli.run(spark, ["make", "-c", "--csv-header", "-o", at])
    cli.run(spark, ["index", "-i", at])
    cli.run(spark, ["dump", "-c", "-i", at, "-F", "a=v1", "-v", "-f", "time"])
    out, told = capsys.readouterr()
    assert sorted(map(int, out.split())) == list(range(1, 30, 3)) and "index:" in told and "filter: a=v1" in told
    other = str(tmp_path / "other")
    write_frame(frame(spark, [("k", 1, 1, "v1", "")]), other)
    cli.run(spark, ["dump", "-c", "-i", other, "-F", "a=v1", "-f", "time"])
    assert capsys.readouterr().out.split() == ["1"]
    with pytest.raises(errors.LaneError):
        cli.run(spark, ["dump", "-c", "-i", other, "-F", "a=v1", "--index-path", at + ".index"])
    assert str(parse("a=x b!=y & c=")) == "a=x b!=y & c="


def test_headers_of_several_files(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text("time,uuid,a\n" + "".join(f"{i},{i + 10 * n:02x},v\n" for i in range(5)))
    f, _ = read_csv(spark, str(tmp_path), delimiter=",", header=True)
    assert f.scan().count() == 15 and f.schema.fields == ("a",)
    (tmp_path / "3.csv").write_text("uuid,time\nab,1\n")
    with pytest.raises(errors.BadInput):
        read_csv(spark, str(tmp_path), delimiter=",", header=True)


def test_streams(spark, tmp_path):
    at = str(tmp_path / "db")
    e = frame(spark, [(f"k{i % 3}", i, i, "x", "") for i in range(30)])
    write_frame(e, at)
    e.df.withColumn("seq", F.col("seq") + 100).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(e.df.schema).parquet(str(tmp_path / "in"))
    append_batches(read(), at, str(tmp_path / "one"), once=True).awaitTermination()
    append_batches(read(), at, str(tmp_path / "again"), once=True).awaitTermination()  # the same batch once more
    assert open_frame(spark, at).scan().count() == 60
    rows = spark.createDataFrame([("u", 0), ("u", 1800), ("u", 3601), ("v", 5)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(str(tmp_path / "times"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "times"))
    q = stream_sessions(stream, "k", "ts").writeStream.format("memory").queryName("closed_sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["events"]) for r in spark.table("closed_sessions").collect()) == [("u", 1), ("u", 2), ("v", 1)]
