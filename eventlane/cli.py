"""Command line: ``make``, ``dump``, ``merge`` and ``index``."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlane.errors import InvalidIndex, LaneError, NotFound
from eventlane.operators.index import PageIndex
from eventlane.operators.merge import merge
from eventlane.operators.trails import TrailFrame
from eventlane.plans.filters import parse
from eventlane.sources import dump_csv, dump_json, open_frame, read_csv, read_json, write_frame
from eventlane.sources.text import STANDARD

INDEX = ".index"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="eventlane")
    p.add_argument("verb", choices=("make", "dump", "merge", "index"))
    p.add_argument("inputs", nargs="*")
    p.add_argument("-c", "--csv", action="store_true")
    p.add_argument("-j", "--json", action="store_true")
    p.add_argument("-i", "--input", default=STANDARD)
    p.add_argument("-o", "--output")
    p.add_argument("-d", "--delimiter", default=" ")
    p.add_argument("-f", "--fields")
    p.add_argument("-F", "--filter")
    p.add_argument("--uuids")
    p.add_argument("-T", "--threads", type=int)
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--store-format", default="dir", choices=("dir", "package"))
    p.add_argument("--csv-header", action="store_true")
    p.add_argument("--json-no-empty", action="store_true")
    p.add_argument("--skip-bad-input", action="store_true")
    p.add_argument("--index-path")
    p.add_argument("--no-index", action="store_true")
    p.add_argument("--no-bigrams", action="store_true")
    return p


def listed_keys(spark: SparkSession, spec: str, verbose: bool = False) -> DataFrame:
    """Keys of ``a,b,c`` or ``@path``: those of exactly 32 hex digits; others are left out and counted."""
    if spec.startswith("@"):
        d = spark.read.text(spec[1:]).select(F.trim("value").alias("k"))
    else:
        d = spark.createDataFrame([(x,) for x in spec.split(",")], "k string")
    fine = F.col("k").rlike("^[0-9a-fA-F]{32}$")
    if verbose:
        r = d.agg(F.count(F.when(fine, 1)).alias("a"), F.count(F.when(~fine, 1)).alias("b")).first()
        print(f"{r['a']} keys, {r['b']} invalid", file=sys.stderr)
    return d.where(fine).select(F.lower("k").alias("k")).distinct()


def find_index(frame: TrailFrame, a: argparse.Namespace) -> PageIndex | None:
    """The index that was named, or the one beside the store; an index of other data is told and, unless it was named, left aside."""
    if a.no_index or a.uuids:
        return None
    try:
        index = PageIndex.load(frame, a.index_path or a.input + INDEX)
    except (AnalysisException, InvalidIndex) as e:
        if a.index_path:
            raise e if isinstance(e, LaneError) else NotFound(a.index_path) from None
        if isinstance(e, InvalidIndex) or a.verbose:
            print("no index is used" if isinstance(e, AnalysisException) else str(e), file=sys.stderr)
        return None
    if a.verbose:
        print(f"index: {index.pages.select('page').distinct().count()} pages", file=sys.stderr)
    return index


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    f = parse(a.filter) if a.filter else None
    if a.verbose and f is not None:
        print(f"filter: {f}", file=sys.stderr)
    if a.threads:
        spark.conf.set("spark.sql.shuffle.partitions", a.threads)
    if a.verb == "make":
        reader = read_json if a.json else read_csv
        more = {} if a.json else {"delimiter": a.delimiter, "header": a.csv_header}
        frame, rejects = reader(spark, a.input, *([a.fields] if a.fields else []), skip_bad=a.skip_bad_input, **more)
        write_frame(frame, a.output, a.store_format)
        if a.skip_bad_input and a.verbose:
            print(f"{rejects.count()} lines skipped", file=sys.stderr)
    elif a.verb == "merge":
        keys = listed_keys(spark, a.uuids, a.verbose) if a.uuids else None
        write_frame(merge([open_frame(spark, p) for p in a.inputs], f, keys), a.output, a.store_format)
    elif a.verb == "index":
        PageIndex.build(open_frame(spark, a.input)).save(a.output or a.input + INDEX)
    else:
        frame = open_frame(spark, a.input)
        if a.uuids:
            frame = frame.only(listed_keys(spark, a.uuids, a.verbose))
        rows = None
        index = find_index(frame, a) if f is not None else None
        if index is not None:
            rows = index.scan(f)
        elif f is not None:
            rows = frame.scan(f)
        names = a.fields.split(",") if a.fields else None
        out = dump_json(frame, names, a.json_no_empty, rows) if a.json else dump_csv(frame, names, a.delimiter, a.csv_header, rows)
        if a.output and a.output != STANDARD:
            out.write.mode("errorifexists").text(a.output)
        else:
            for r in out.toLocalIterator():
                print(r["value"])
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("eventlane").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, sys.argv[1:])
    except LaneError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
