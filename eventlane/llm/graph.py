"""Connected components by alternating large and small stars, cut by reliable checkpoints."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder of the session; a folder of our own only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(shared)


#: Whether the files that an execution shuffled go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared checkpoint folder; what was shuffled for it is not needed any more and goes."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # an execution of its own, planned with this setting
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


#: Edges that a task holds while it thins them.
HELD = 1 << 18


def forest(batches):
    """Arrow batches of edges (``a``, ``b``) to fewer that connect the same nodes: a spanning forest of each ``HELD`` edges."""
    held, n = [], 0

    def thin():
        a, b = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        above: dict[int, int] = {}
        out = []
        for edge in zip(a.tolist(), b.tolist(), strict=True):
            ends = []
            for x in edge:
                top = x
                while (up := above.get(top, top)) != top:
                    top = up
                while x != top:
                    above[x], x = top, above.get(x, x)
                ends.append(top)
            u, v = ends
            if u != v:
                above[max(u, v)] = min(u, v)
                out.append(edge)
        got = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += len(batch)
        if n >= HELD:
            yield thin()
            held, n = [], 0
    if n:
        yield thin()


#: Edges that one task takes; fewer need no exchange between the steps of a round.
EDGES_PER_TASK = 200_000


def _dealt(e: DataFrame, n: int) -> DataFrame:
    """Edges in as many parts as their number asks for (never more than they have)."""
    return e.coalesce(max(1, -(-n // EDGES_PER_TASK)))


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """``node`` and ``root`` (the least node reachable) for each node of ``edges`` (``a``, ``b``, longs).

    Rounds of large and small stars until the edges stay as they are; each
    round is two joins and aggregations with map-side combining, so a node with
    very many neighbours is an aggregate, not a list.  An edge from a node to
    itself gives that node; no edges give no rows.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(e)
    e = _dealt(e, mark[0])
    for _ in range(most):
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p")).select("p.u", "p.v")
        least = both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.col("x")).alias("m"))
        large = both.where("v >= u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.col("x")).alias("m"))
        small = large.join(least, F.col("u") == F.col("x"))
        e = cut(small.select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").distinct())
        mark, before = _mark(e), mark
        if mark == before:
            break
        e = _dealt(e, mark[0])
    else:
        raise RuntimeError("the components have not settled")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def _mark(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
