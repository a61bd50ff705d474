"""Delimited text and JSON lines, in and out.

Delimited lines have no quotes: two delimiters in a row hold an empty value,
missing columns are empty, more columns than named are ignored.  A key is hex
text, padded on the right with zeros.  A time is a whole number; empty is 0 and
-1 counts as missing.

Bad rows raise, or with ``skip_bad`` go to the second result: no key, a key
that isn't one, no time.  A time that isn't a number, and JSON that can't be
read or holds an object or array where a value is wanted, always raise.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlane.errors import BadInput, DuplicateFields, InvalidOptionValue, UnknownField
from eventlane.functions.keys import parse_key
from eventlane.operators.trails import TrailFrame
from eventlane.plans.schema import TrailSchema, check_fields

KEY, TIME = "uuid", "time"


def field_map(spec: str = f"{KEY},{TIME}") -> list[tuple[int, str]]:
    """Columns from ``"uuid,time,a"`` (by place) or ``"2:uuid,5:time,30:a"`` (by number from 1), in order of fields."""
    out: dict[str, int] = {}
    for place, part in enumerate(spec.split(","), 1):
        number, colon, name = part.partition(":")
        if not colon:
            number, name = str(place), part
        if not number.isdigit() or int(number) < 1:
            raise InvalidOptionValue(part)
        if name in out:
            raise DuplicateFields(name)
        out[name] = int(number)
    for name in (KEY, TIME):
        if name not in out:
            raise UnknownField(f"{name} must be among the fields")
    check_fields([n for n in out if n not in (KEY, TIME)])
    return [(k, n) for n, k in out.items()]


def _time(text: Column) -> tuple[Column, Column]:
    """Value (null: missing) and whether it can't be read."""
    number = text.try_cast("long")
    fine = text.rlike(r"^\s*[+-]?[0-9]+$") & number.isNotNull()
    value = F.when(text == "", F.lit(0).cast("long")).when(fine & (number != -1), number)
    return value, ~fine & (text != "")


def _checked(d: DataFrame, fields: list[str], skip_bad: bool) -> tuple[TrailFrame, DataFrame]:
    """From text columns ``uuid``, ``time``, ``seq``, ``line``, fields and ``fatal`` (a reason or null)."""
    key = parse_key(F.col(KEY))
    time, unreadable = _time(F.coalesce(F.col(TIME), F.lit("-1")))
    fatal = F.coalesce(F.col("fatal"), F.when(unreadable, F.concat(F.lit("invalid timestamp: "), F.col(TIME))))
    why = F.when(F.col(KEY).isNull(), "no uuid").when(key.isNull(), F.concat(F.lit("invalid uuid: "), F.col(KEY))).when(time.isNull(), "no time")
    d = d.select(key.alias("trail_key"), time.alias("time"), "seq", *[F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(f) for f in fields], "line", fatal.alias("fatal"), why.alias("why"))
    stop = F.col("fatal") if skip_bad else F.coalesce("fatal", "why")
    d = d.withColumn("ok", F.when(stop.isNotNull(), F.raise_error(F.concat(F.lit("BAD_INPUT: "), stop)).cast("boolean")).otherwise(F.col("why").isNull()))
    schema = TrailSchema(tuple(fields))
    return TrailFrame(d.where("ok").select(*schema.columns), schema), d.where("not ok").select("line", "why")


#: The path that stands for standard input and output.
STANDARD = "-"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``seq``, ``file`` and ``head`` (the line lies in the first block of its file).

    Standard input passes through this process: it is for pipes, not for bulk.
    """
    if path == STANDARD:
        rows = [(line.removesuffix("\n"), i) for i, line in enumerate(sys.stdin)]
        return spark.createDataFrame(rows, "line string, seq long").select("line", "seq", F.lit(path).alias("file"), F.lit(True).alias("head"))
    d = spark.read.text(path)
    return d.select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("seq"), F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("head"))


def _without_header(d: DataFrame) -> tuple[str, DataFrame]:
    """The header that all files have as their first line, and the other lines; a file with another header is refused."""
    first = d.where("head").groupBy("file").agg(F.min(F.struct("seq", "line")).alias("x")).select(F.col("x.seq").alias("first_seq"), F.col("x.line").alias("header"))
    rows = first.collect()  # one a file, as in the list of files that this process holds anyway
    kinds = sorted({r["header"] for r in rows})
    if not kinds:
        raise BadInput("no header")
    if len(kinds) > 1:
        raise BadInput(f"files with different headers: {kinds[0]!r} and {kinds[1]!r}")
    # a condition, not a join: checks of the other lines must not move before it
    return kinds[0], d.where(~F.col("seq").isin([r["first_seq"] for r in rows]))


def read_csv(spark: SparkSession, path: str, fields: str = f"{KEY},{TIME}", delimiter: str = " ", header: bool = False, skip_bad: bool = False) -> tuple[TrailFrame, DataFrame]:
    """Frame and rejected lines of delimited text; with ``header`` the first line of each file names the columns."""
    if len(delimiter) != 1:
        raise InvalidOptionValue("the delimiter is one character")
    d = _lines(spark, path)
    if header:
        line, d = _without_header(d)
        fields = ",".join(line.split(delimiter))
    spec = field_map(fields)
    pattern = delimiter if delimiter.isalnum() or delimiter == " " else "\\" + delimiter
    parts = F.split("line", pattern, -1)
    d = d.select("line", "seq", F.lit(None).cast("string").alias("fatal"), *[F.get(parts, k - 1).alias(n) for k, n in spec])
    return _checked(d, [n for _, n in spec if n not in (KEY, TIME)], skip_bad)


def read_json(spark: SparkSession, path: str, fields: str = f"{KEY},{TIME}", skip_bad: bool = False) -> tuple[TrailFrame, DataFrame]:
    """Frame and rejected lines of one object a line; numbers and booleans keep their spelling, null is empty, other keys are ignored."""
    names = list(dict.fromkeys([KEY, TIME, *[n for n in fields.split(",") if n]]))
    wanted = [n for n in names if n not in (KEY, TIME)]
    check_fields(wanted)
    shape = T.StructType([T.StructField(n, T.StringType()) for n in names])
    v = F.try_parse_json("line")
    kinds = [F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$['{n}']", "variant")), F.lit("")) for n in names]
    nested = F.lit(False)
    for k in kinds:
        nested = nested | k.startswith("OBJECT") | k.startswith("ARRAY")
    d = _lines(spark, path).where("line <> ''").withColumn("o", F.from_json("line", shape))
    fatal = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.concat(F.lit("invalid JSON: "), F.col("line"))).when(nested, F.concat(F.lit("nested value: "), F.col("line")))

    def spelled(n: str, kind: Column) -> Column:
        """A number as it is written: the parser would write 1.50 as 1.5."""
        text = F.regexp_extract("line", f'"{n}"\\s*:\\s*(-?[0-9][-+0-9.eE]*)', 1)
        same = text.try_cast("double") == F.col("o")[n].try_cast("double")
        return F.when(~kind.isin("", "STRING", "BOOLEAN", "VOID") & same, text).otherwise(F.col("o")[n])

    d = d.select("line", "seq", fatal.alias("fatal"), *[spelled(n, k).alias(n) for n, k in zip(names, kinds, strict=True)])
    return _checked(d, wanted, skip_bad)


def _slots(frame: TrailFrame, fields) -> list[str]:
    names = list(fields) if fields else [KEY, TIME, *frame.schema.fields]
    for n in names:
        if n not in (KEY, TIME, *frame.schema.fields):
            raise UnknownField(n)
    if len(set(names)) < len(names):
        raise DuplicateFields(", ".join(names))
    return names


def _cell(frame: TrailFrame, name: str) -> Column:
    c = {KEY: frame.schema.key, TIME: frame.schema.time}.get(name, name)
    return F.col(f"`{c}`").cast("string")


def dump_csv(frame: TrailFrame, fields=None, delimiter: str = " ", header: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """``value``: a line for each event, trail by trail; values are joined as they are."""
    names = _slots(frame, fields)
    s = frame.schema
    d = (frame.scan() if rows is None else rows).repartition(s.key).sortWithinPartitions(s.key, s.time, s.seq)
    lines = d.select(F.concat_ws(delimiter, *[_cell(frame, n) for n in names]).alias("value"))
    if header:
        lines = frame.df.sparkSession.createDataFrame([(delimiter.join(names),)], "value string").union(lines)
    return lines


def dump_json(frame: TrailFrame, fields=None, no_empty: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """``value``: a JSON object of strings for each event; with ``no_empty`` without empty values."""
    names = _slots(frame, fields)
    s = frame.schema
    d = (frame.scan() if rows is None else rows).repartition(s.key).sortWithinPartitions(s.key, s.time, s.seq)
    cell = lambda n: F.nullif(_cell(frame, n), F.lit("")) if no_empty else _cell(frame, n)
    return d.select(F.to_json(F.struct(*[cell(n).alias(n) for n in names])).alias("value"))
