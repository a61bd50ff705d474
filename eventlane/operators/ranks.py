"""Contiguous global numbers without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
#: Steps by quantiles: each is a branch of the expression that finds a row's step.
STEPS = 256


def ordinal(df: DataFrame, name: str, order: Column, bucket: Column, part: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``name``: position from 0 by ``order`` within ``part``.

    ``bucket`` is a number that never falls as ``order`` grows.  Rows are
    numbered inside a bucket and shifted by the sizes of the buckets before, so
    only one row a bucket meets in one place.
    """
    d = df.withColumn("ord_b", bucket.cast("long"))
    before = Window.partitionBy(*part).orderBy("ord_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = d.groupBy(*part, "ord_b").agg(F.count(F.lit(1)).alias("ord_n")).withColumn("ord_s", F.coalesce(F.sum("ord_n").over(before), F.lit(0)))
    names = {p: f"ord_{i}" for i, p in enumerate(part)}
    shift = shift.select(F.col("ord_b").alias("ord_k"), "ord_s", *[F.col(p).alias(q) for p, q in names.items()])
    inside = Window.partitionBy(*part, "ord_b").orderBy(order)
    on = F.col("ord_b") == F.col("ord_k")
    for p, q in names.items():
        on = on & (F.col(p) == F.col(q))
    out = d.withColumn("ord_r", F.row_number().over(inside)).join(shift, on)
    return out.select(*df.columns, (F.col("ord_s") + F.col("ord_r") - 1).cast("long").alias(name))


def number_bucket(c: Column, low, high) -> Column:
    """Equal steps from ``low`` to ``high``."""
    if low is None or high is None or high <= low:
        return F.lit(0)
    return F.floor((c.cast("double") - F.lit(float(low))) * F.lit(BUCKETS / (float(high) - float(low))))


def quantile_bucket(df: DataFrame, name: str) -> Column:
    """Steps that hold about as many rows each, however the numbers lie; equal numbers share a step."""
    bounds = df.agg(F.percentile_approx(name, [k / STEPS for k in range(1, STEPS)], F.lit(10 * STEPS)).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    return _step(F.col(name), bounds)


def _step(c: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are at most ``c``: a search in halves, about eight comparisons a row."""
    if not bounds:
        return F.lit(0)
    if len(bounds) == 1:
        return F.when(c >= F.lit(bounds[0]), 1).otherwise(0)
    mid = len(bounds) // 2
    return F.when(c < F.lit(bounds[mid]), _step(c, bounds[:mid])).otherwise(_step(c, bounds[mid + 1 :]) + F.lit(mid + 1))


def hex_bucket(c: Column) -> Column:
    return F.conv(F.substring(c, 1, 3), 16, 10).cast("long")
