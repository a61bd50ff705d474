"""The Parquet store: events by key and time, and one row about them.

``<path>/meta`` is one row and names the folder of the data.  It is written
last: a store without it doesn't exist, so a write that broke off can be
repeated.  Data lies under ``batch=...`` folders, that of the first write under
``batch=base``; later ones come from streams.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventlane.errors import InvalidOptionValue, NotFound, OutputExists, TimestampTooLarge, VersionMismatch
from eventlane.operators.trails import VERSION, TrailFrame
from eventlane.plans.schema import TIME_LIMIT, TrailSchema

SUFFIX = ".lane"
FORMATS = ("dir", "package")


def scratch(spark: SparkSession) -> str:
    """A folder for intermediate files that all executors share: the session's, or one of our own where all runs on this machine."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise InvalidOptionValue("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="scratch-")
        sc.setCheckpointDir(at)
    return at


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(f"{path}/meta").columns)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def write_frame(frame: TrailFrame, path: str, fmt: str = "dir", options: dict | None = None) -> None:
    """Writes what the frame's filters let through; an existing output is refused.

    ``dir`` keeps many files, dealt by ranges of the key and sorted by key and
    time, so that a key predicate skips files and row groups; ``package``
    writes one file: the same files, in the shared folder, are copied into it in
    their order by a task that sorts nothing.  Counts and the largest time
    differences are taken in the pass that writes first; times beyond the limits
    leave no store behind.
    """
    spark, s = frame.df.sparkSession, frame.schema
    if fmt not in FORMATS:
        raise InvalidOptionValue(fmt)
    if _exists(spark, path):
        raise OutputExists(path)
    own = frame.extract()
    before = F.lag(s.time).over(own.window)
    seen = Observation()
    d = own.df.repartitionByRange(s.key).withColumn("before", before).observe(
        seen,
        F.count(F.lit(1)).alias("num_events"),
        F.count(F.when(F.col("before").isNull(), 1)).alias("num_trails"),
        F.min(s.time).alias("min_timestamp"),
        F.max(s.time).alias("max_timestamp"),
        F.max(F.col(s.time) - F.col("before")).alias("gap"),
        F.max(F.when(F.col("before").isNull(), F.col(s.time))).alias("last_start"),
    )
    data = f"data-{uuid.uuid4()}"
    base = f"{path}/{data}/batch=base"
    parts = base if fmt == "dir" else f"{scratch(spark)}/parts-{uuid.uuid4()}"
    d.sortWithinPartitions(s.key, s.time, s.seq).drop("before").write.options(**(options or {})).parquet(parts)
    m = seen.get
    low = m["min_timestamp"]
    if low is not None and (low < 0 or low >= TIME_LIMIT or (m["gap"] or 0) >= TIME_LIMIT or m["last_start"] - low >= TIME_LIMIT):
        raise TimestampTooLarge(f"from {low} to {m['max_timestamp']}")
    if fmt == "package":
        _in_order(spark, parts).coalesce(1).write.options(**(options or {})).parquet(base)
    row = (m["num_trails"], m["num_events"], s.num_fields, low, m["max_timestamp"], VERSION, list(s.fields), data)
    kinds = "num_trails long, num_events long, num_fields long, min_timestamp long, max_timestamp long, version long, fields array<string>, data string"
    try:
        spark.createDataFrame([row], kinds).coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta")
    except AnalysisException as e:
        if "ALREADY_EXISTS" in str(e):
            raise OutputExists(path) from None
        raise


def _in_order(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder, one after the other (a scan of the folder takes them by size)."""
    d = spark.read.parquet(path)
    return reduce(DataFrame.unionAll, [spark.read.schema(d.schema).parquet(unquote(f)) for f in sorted(d.inputFiles())])


def stored_meta(spark: SparkSession, path: str):
    """The row written with the data: nothing is counted again."""
    for p in (path, path + SUFFIX):
        if _exists(spark, p):
            row = spark.read.parquet(f"{p}/meta").first()
            if row["version"] != VERSION:
                raise VersionMismatch(f"{row['version']}, not {VERSION}")
            return row
    raise NotFound(path)


def data_folder(spark: SparkSession, path: str) -> str:
    """Where the data of the store at ``path``, or at ``path`` with the store's suffix, lies."""
    p = path if _exists(spark, path) else path + SUFFIX
    return f"{p}/{stored_meta(spark, path)['data']}"


def open_frame(spark: SparkSession, path: str) -> TrailFrame:
    """The frame at ``path``, or at ``path`` with the store's suffix."""
    schema = TrailSchema(tuple(stored_meta(spark, path)["fields"]))
    return TrailFrame(spark.read.parquet(data_folder(spark, path)).select(*schema.columns), schema)
