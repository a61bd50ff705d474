"""Text sources and sinks, the store, key order and sessions."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventlane import cli, errors
from eventlane.functions import item_field, item_value, key_order, pack_item, parse_key
from eventlane.operators import TrailFrame
from eventlane.plans.filters import EventFilter
from eventlane.sources import dump_csv, dump_json, field_map, open_frame, read_csv, read_json, write_frame


def test_csv_in_and_out(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("".join(f"{i:032x} {i + 100} FF{i} SS{i}\n" for i in range(100)) + "ab 5  x extra\n")
    f, bad = read_csv(spark, str(p), "uuid,time,first,second")
    assert bad.count() == 0 and f.scan().count() == 101
    assert f.trail("ab" + "0" * 30).first().asDict() | {"seq": 0} == {"trail_key": "ab" + "0" * 30, "time": 5, "seq": 0, "first": "", "second": "x"}
    out = {r[0] for r in dump_csv(f).collect()}
    assert f"{7:032x} 107 FF7 SS7" in out
    assert field_map("2:uuid,5:time,30:f") == [(2, "uuid"), (5, "time"), (30, "f")]
    with pytest.raises(errors.UnknownField):
        field_map("uuid,a")


def test_bad_rows(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("zz,1\nab,2\nab,-1\nab,\n")
    f, bad = read_csv(spark, str(p), delimiter=",", skip_bad=True)
    assert sorted(r["time"] for r in f.scan().collect()) == [0, 2] and bad.count() == 2
    with pytest.raises(PySparkException):
        read_csv(spark, str(p), delimiter=",")[0].scan().collect()
    p.write_text("ab,xyz\n")
    with pytest.raises(PySparkException):
        read_csv(spark, str(p), delimiter=",", skip_bad=True)[0].scan().collect()


def test_json_in_and_out(spark, tmp_path):
    p = tmp_path / "in.json"
    p.write_text('{"uuid":"ab","time":3,"a":1.50,"b":null,"other":[1]}\n{"time":"4","uuid":"cd","a":"x\\"y","b":true}\n')
    f, _ = read_json(spark, str(p), "a,b")
    rows = {r["time"]: (r["a"], r["b"]) for r in f.scan().collect()}
    assert rows == {3: ("1.50", ""), 4: ('x"y', "true")}
    assert '{"time":"3","a":"1.50"}' in {r[0] for r in dump_json(f, ["time", "a", "b"], no_empty=True).collect()}
    p.write_text('{"uuid":"ab","time":3,"a":{"b":1}}\n')
    with pytest.raises(PySparkException):
        read_json(spark, str(p), "a")[0].scan().collect()


def test_store_and_cli(spark, tmp_path, capsys):
    src = tmp_path / "in.csv"
    src.write_text("".join(f"{i:032x} {i} {i} {i % 10}\n" for i in range(50)))
    at = str(tmp_path / "db.lane")
    assert cli.run(spark, ["make", "-c", "-i", str(src), "-o", at, "-f", "uuid,time,first,second"]) == 0
    f = open_frame(spark, at.removesuffix(".lane"))
    assert f.schema.fields == ("first", "second") and f.scan(EventFilter().add_term("second", "3")).count() == 5
    with pytest.raises(errors.OutputExists):
        write_frame(f, at)
    with pytest.raises(errors.NotFound):
        open_frame(spark, str(tmp_path / "none"))
    cli.run(spark, ["index", "-i", at])
    cli.run(spark, ["dump", "-c", "-i", at, "-F", "second=3", "--index-path", at + ".index", "-f", "first"])
    cli.run(spark, ["merge", at, at, "-o", str(tmp_path / "m"), "-F", "second=3"])
    assert len(capsys.readouterr().out.split()) == 5 and open_frame(spark, str(tmp_path / "m")).scan().count() == 10


def test_time_limits(spark, tmp_path):
    big = (1 << 47) - 1
    make = lambda *t: TrailFrame.of(spark.createDataFrame([("k", x, i) for i, x in enumerate(t)], "k string, t long, s long"), "k", "t", "s", ())
    write_frame(make(0, big - 1), str(tmp_path / "a"))
    with pytest.raises(errors.TimestampTooLarge):
        write_frame(make(0, big), str(tmp_path / "b"))
    write_frame(make(1).with_filter(EventFilter.match_none()), str(tmp_path / "c"))
    assert open_frame(spark, str(tmp_path / "c")).scan().count() == 0


def test_keys_items_sessions(spark):
    ks = ["01" + "0" * 30, "00" * 15 + "01", "ff" + "0" * 30]
    d = spark.createDataFrame([(k,) for k in ks], "k string")
    assert [r[0] for r in d.orderBy(key_order(F.col("k"))).collect()] == [ks[0], ks[2], ks[1]]
    assert d.select(parse_key(F.lit("AB")), parse_key(F.lit("xy"))).first()[0] == "ab" + "0" * 30
    x = spark.createDataFrame([(1, 5), (127, 1 << 23), (128, 1), (16000, (1 << 40) - 1), (3, 1 << 30)], "f long, v long").withColumn("x", pack_item(F.col("f"), F.col("v")))
    assert x.where((item_field(F.col("x")) != F.col("f")) | (item_value(F.col("x")) != F.col("v"))).count() == 0
    e = TrailFrame.of(spark.createDataFrame([("k", t, t) for t in (0, 1800, 3601)], "k string, t long, s long"), "k", "t", "s", ())
    assert e.sessions().first()["sessions"] == 2
