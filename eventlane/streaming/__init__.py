"""Streams of events (an extension: trails are otherwise immutable)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlane.operators.trails import SESSION_GAP
from eventlane.sources.store import data_folder


def stream_sessions(stream: DataFrame, key: str, ts: str, gap: int = SESSION_GAP, late: str = "1 hour") -> DataFrame:
    """Sessions of a stream as they close: key, start, end (last event) and events.

    As with trails, a gap equal to ``gap`` doesn't split a session.
    """
    w = F.session_window(F.col(ts), f"{gap} seconds")
    out = stream.withWatermark(ts, late).groupBy(F.col(key), w).agg(F.count(F.lit(1)).alias("events"), F.max(ts).alias("end"))
    return out.select(F.col(key), F.col("session_window.start").alias("start"), "end", "events")


def append_batches(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Each micro-batch becomes a folder of the store at ``path``, by ranges of the key and sorted; returns the query.

    The folder has the batch's number: a batch that is repeated after a failure
    takes the place of its first try.  The counts in the store's ``meta`` stay
    those of the first write; ``TrailFrame.meta`` counts anew.  With ``once``
    the query ends when it has taken all that is there.
    """
    folder = data_folder(stream.sparkSession, path)

    def add(batch: DataFrame, number: int) -> None:
        batch.repartitionByRange("trail_key").sortWithinPartitions("trail_key", "time", "seq").write.mode("overwrite").parquet(f"{folder}/batch=stream-{number}")

    out = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
