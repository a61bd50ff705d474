"""Registered queries against their statements, on tables made to tell them apart."""

import datetime
import random
import time

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from eventlane.operators import TrailFrame
from eventlane.plans.filters import EventFilter, Term, TimeRange
from eventlane.sources import open_frame, write_frame


def agrees(spark, name, at):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    c.execute(f"create view events as select * from '{at}/events.parquet{'/*.parquet' if at.joinpath('events.parquet').is_dir() else ''}'")
    q = __spark_entry__.queries()[name](spark, str(at))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = c.execute(f"select {', '.join(f'"{x}"' for x in q.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in q.collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and got
    return got


def events(spark, at, rows):
    """``rows``: user, type and props; one a second."""
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(i, t + datetime.timedelta(seconds=i), u, e, 1.0, p) for i, (u, e, p) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{at}/events.parquet")


def test_trail_filters_reach_trails_beyond_the_lists(spark, tmp_path):
    events(spark, tmp_path, [(u, e, "") for u in (-7, -4, 2, 3, 4, 1502, 1503, 7493, 7503, 7504, 90003, None) for e in ("click", "view", "view")])
    got = dict(agrees(spark, "many_trail_filters", tmp_path))
    assert got[90003] == got[7503] == got[3] == 0 and got[-4] == got[4] == 2 and got[None] == got[1502] == 1


def test_the_trail_filter_given_last_holds(spark):
    e = TrailFrame.of(spark.range(40).select((F.col("id") % 4).alias("k"), F.col("id").alias("t")), "k", "t", None, ())
    keys = spark.createDataFrame([(1,), (2,), (2,), (9,)], "k long")
    none = EventFilter.match_none()
    f = e.with_trail_filter([0, 1], none).with_trail_filter(keys, EventFilter().add_time_range(0, 20))
    counts = lambda f: {r["trail_key"]: r["n"] for r in f.lengths().collect()}
    assert counts(f) == {0: 0, 1: 5, 2: 5, 3: 10} and f.scan().count() == 20 and f.trail_filter(0) == none
    assert counts(f.with_trail_filter([2], none)) == {0: 0, 1: 5, 2: 0, 3: 10}
    assert counts(f.with_trail_filter(keys, None)) == {0: 0, 1: 10, 2: 10, 3: 10}


def test_places_in_trail_order_are_those_of_one_sort(spark, tmp_path):
    events(spark, tmp_path, [(None if i % 5000 == 7 else i * 7919 % 30011 % 997, f"v{i % 5}", f"{i * 31 % 1009:064d}") for i in range(30000)])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:  # many small partitions, of which adaptive execution joins some
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
        got = agrees(spark, "trail_order_scan", tmp_path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r[-1] for r in got) == list(range(1, 30001))


def test_a_package_is_sorted_by_many_tasks_and_written_by_one(spark, tmp_path):
    d = spark.range(0, 60000, 1, 1).select((F.col("id") * 7919 % 601).alias("k"), (F.col("id") * 31 % 997).alias("t"), "id", F.md5(F.col("id").cast("string")).alias("a"))
    e = TrailFrame.of(d, "k", "t", "id", ("a",))
    sc, name = spark.sparkContext, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "128k")
        sc.setJobGroup("package", "")
        write_frame(e, str(tmp_path / "p"), "package")
    finally:
        spark.conf.set(name, before)
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(x) for j in tracker.getJobIdsForGroup("package") for x in tracker.getJobInfo(j).stageIds]
    assert max(x.numTasks for x in stages if x) > 1  # the input has one partition
    files = list(tmp_path.glob("p/data-*/batch=base/*.parquet"))
    got = duckdb.sql(f"select trail_key, \"time\", seq, a from '{files[0]}'").fetchall()
    assert len(files) == 1 and got == sorted(tuple(r) for r in e.df.collect())
    write_frame(e.with_filter(EventFilter.match_none()), str(tmp_path / "none"), "package")
    assert open_frame(spark, str(tmp_path / "none")).scan().count() == 0


def test_many_clauses_cost_little_a_row(spark):
    d = spark.range(0, 200000, 1, 4).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"), F.concat(F.lit("v"), F.col("id") % 5).alias("a"), F.concat(F.lit("p"), F.col("id") % 9000).alias("b"))
    f = EventFilter([[Term("a", "v1"), Term("b", f"p{i}")] for i in range(5000)])
    e = TrailFrame.of(d, "k", "t", None, ("a", "b"))
    e.scan(f).limit(1).count()
    began = time.time()
    assert e.scan(f).count() == 40000 and time.time() - began < 12


def test_many_clauses_by_all_ways(spark):
    """Clauses that only several fields and times together make hold, against the terms one by one."""
    rng = random.Random(5)
    rows = [(i % 3, i, rng.choice(["", "é", "b", "c", "'\""]), rng.choice(["", "x", "y", "z"])) for i in range(120)]
    e = TrailFrame.of(spark.createDataFrame(rows, "k long, t long, a string, b string"), "k", "t", None, ("a", "b"))

    def term():
        if rng.random() < 0.3:
            x = rng.randrange(-5, 110)
            return TimeRange(x, x + rng.randrange(1, 70))
        return Term(*rng.choice([("a", "é"), ("a", "b"), ("a", "'\""), ("a", ""), ("b", "x"), ("b", "y"), ("b", ""), ("b", "none"), ("no", "x")]), rng.random() < 0.35)

    def holds(t, r):
        if isinstance(t, TimeRange):
            return t.start <= r[1] < t.end
        return (dict(a=r[2], b=r[3]).get(t.field) == t.value) != t.negated

    some = 0
    for _ in range(12):
        clauses = []
        while len(clauses) < 150:  # each holds for most rows, so that some rows are left
            c = [term() for _ in range(rng.randrange(1, 7))]
            n = sum(any(holds(t, r) for t in c) for r in rows)
            clauses += [c] if n > 100 or rng.random() < 0.0005 else []
        want = [r[1] for r in rows if all(any(holds(t, r) for t in c) for c in clauses)]
        assert sorted(r["time"] for r in e.scan(EventFilter(clauses)).collect()) == want
        some += len(want)
    assert some
