"""Appending, merging by schema union, and time-ordered merges over several frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlane.errors import DiffWithFilter, FieldsMismatch
from eventlane.operators.trails import TrailFrame
from eventlane.plans.filters import EventFilter
from eventlane.plans.schema import TrailSchema


def _united(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _numbered(frames: list[DataFrame]) -> DataFrame:
    """All rows; ties, and first appearances of values, keep the order of the frames.

    Where the ``seq`` of a frame doesn't lie above that of the frames before, it
    is moved there: one aggregate over that column of each frame.
    """
    bounds = _united([d.agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.lit(i).alias("frame")) for i, d in enumerate(frames)]).collect()
    out, top = [], None
    for r, d in zip(sorted(bounds, key=lambda r: r["frame"]), frames, strict=True):
        shift = 0 if top is None or r["low"] is None or r["low"] > top else top + 1 - r["low"]
        out.append(d.withColumn("seq", F.col("seq") + F.lit(shift).cast("long")) if shift else d)
        top = top if r["high"] is None else r["high"] + shift
    return _united(out)


def append(base: TrailFrame, other: TrailFrame) -> TrailFrame:
    """``base`` and what the filters of ``other`` let through; field names and their order must be equal, copies stay."""
    if base.schema.fields != other.schema.fields:
        raise FieldsMismatch(f"{base.schema.fields} and {other.schema.fields}")
    if other.only_diff:
        raise DiffWithFilter("a frame of changed items would lose its unchanged values")
    return TrailFrame(_numbered([base.df, other.scan()]), base.schema)


def merge(frames: list[TrailFrame], scan_filter: EventFilter | None = None, keys: DataFrame | None = None) -> TrailFrame:
    """All frames in one: equal field lists stay, others become their sorted union with empty values where a field is missing."""
    lists = {f.schema.fields for f in frames}
    fields = frames[0].schema.fields if len(lists) == 1 else tuple(sorted({x for f in lists for x in f}))
    schema = TrailSchema(fields)
    parts = []
    for f in frames:
        d = (f.only(keys) if keys is not None else f).scan(scan_filter)
        parts.append(d.select("trail_key", "time", "seq", *[F.col(f"`{x}`") if x in f.schema.fields else F.lit("").alias(x) for x in fields]))
    return TrailFrame(_numbered(parts), schema)


def multi_merge(frames: list[TrailFrame], fields=()) -> DataFrame:
    """Events of several frames with ``cursor_idx``, the frame's number, and ``position``: the place in its trail by time, ``cursor_idx``, ``seq``."""
    from pyspark.sql import Window

    parts = [f.scan().select("trail_key", "time", "seq", F.lit(i).cast("long").alias("cursor_idx"), *[F.col(f"`{x}`") for x in fields]) for i, f in enumerate(frames)]
    w = Window.partitionBy("trail_key").orderBy("time", "cursor_idx", "seq")
    return _united(parts).withColumn("position", F.row_number().over(w).cast("long"))


def merged_order(frames: list[TrailFrame], fields=()) -> DataFrame:
    """All events of several frames as one sequence by time, ``cursor_idx``, ``seq`` (a range-partitioned sort)."""
    parts = [f.scan().select("trail_key", "time", "seq", F.lit(i).cast("long").alias("cursor_idx"), *[F.col(f"`{x}`") for x in fields]) for i, f in enumerate(frames)]
    return _united(parts).orderBy("time", "cursor_idx", "seq")


def merged_peek(frames: list[TrailFrame], fields=(), n: int = 1) -> DataFrame:
    """The next ``n`` events of the merged sequence (a top-n, not a sort)."""
    return merged_order(frames, fields).limit(n)
