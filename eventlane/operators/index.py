"""Page index: which runs of trails have a value, as a second access path.

A page is a run of trail ids.  A filter gives candidate pages: pages of the
values of a clause together, and those common to all clauses.  Negated terms
and time ranges say nothing about pages, so their clause means all pages.  The
result of a scan is the same with and without the index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlane.errors import InvalidIndex
from eventlane.operators.trails import TrailFrame
from eventlane.plans.filters import EventFilter, Term

#: Most pages of an index (a fixed value).
MAX_PAGES = 65534
#: Most ranges of keys in a scan's predicate; beyond it the closest ones are joined.
RANGES = 128


class PageIndex:
    def __init__(self, frame: TrailFrame, items: DataFrame, pages: DataFrame, checksum: int | None = None):
        self.frame, self.items, self.pages, self.checksum = frame, items, pages, checksum

    @staticmethod
    def checksum_of(frame: TrailFrame) -> int:
        m = frame.meta()
        return m.select(F.xxhash64(*m.columns)).first()[0]

    @classmethod
    def build(cls, frame: TrailFrame, max_pages: int = MAX_PAGES) -> PageIndex:
        """``items`` (``field``, ``value``, ``page``) and ``pages`` (``trail_key``, ``page``)."""
        s = frame.schema
        ids = frame.trail_ids()
        per_page = 1 + ids.count() // max_pages
        pages = ids.select(F.col("trail_key").alias("page_key"), (F.floor(F.col("trail_id") / per_page) + 1).cast("long").alias("page"))
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in s.fields])
        own = frame.df.select(F.col(s.key).alias("own_key"), F.explode(pairs).alias("p")).select("own_key", "p.field", "p.value").distinct()
        items = own.join(pages, F.col("own_key") == F.col("page_key")).select("field", "value", "page").distinct()
        return cls(frame, items, pages, cls.checksum_of(frame))

    def bitmaps(self) -> DataFrame:
        """The index as bitmaps: ``field``, ``value``, ``bucket``, ``bitmap``."""
        return self.items.groupBy("field", "value", F.bitmap_bucket_number("page").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("page")).alias("bitmap"))

    def candidates(self, f: EventFilter) -> DataFrame:
        """``page``: a superset of the pages with a matching event."""
        every = self.pages.select("page").distinct()
        if f.every:
            return every
        if any(not c for c in f.clauses):
            return every.limit(0)
        parts = []
        for n, clause in enumerate(f.clauses):
            if any(not isinstance(t, Term) or t.negated for t in clause):
                continue
            known = [t for t in clause if t.field in self.frame.schema.fields]
            hit = reduce(lambda a, b: a | b, [(F.col("field") == t.field) & (F.col("value") == t.value) for t in known], F.lit(False))
            parts.append(self.items.where(hit).select("page", F.lit(n).alias("clause")))
        if not parts:
            return every
        both = reduce(lambda a, b: a.union(b), parts).groupBy("page").agg(F.countDistinct("clause").alias("n"))
        return both.where(F.col("n") == len(parts)).select("page")

    def ranges(self, f: EventFilter) -> list[tuple]:
        """Least and greatest key of each run of candidate pages, ``RANGES`` at most.  An index has at most ``MAX_PAGES`` pages, so these fit here."""
        page = self.candidates(f).withColumnRenamed("page", "hit")
        bounds = self.pages.groupBy("page").agg(F.min("page_key").alias("low"), F.max("page_key").alias("high"))
        rows = sorted((r["low"], r["high"], r["page"]) for r in bounds.join(page, F.col("page") == F.col("hit"), "left_semi").collect())
        runs: list[list] = []
        for low, high, n in rows:
            if runs and (low <= runs[-1][1] or n == runs[-1][2] + 1):
                runs[-1][1:] = [max(high, runs[-1][1]), n]
            else:
                runs.append([low, high, n])
        while len(runs) > RANGES:  # still a superset: the filter itself decides
            runs = [[a[0], (b or a)[1], (b or a)[2]] for a, b in zip(runs[::2], [*runs[1::2], *[None] * (len(runs) % 2)], strict=True)]
        return [(a, b) for a, b, _ in runs]

    def scan(self, f: EventFilter) -> DataFrame:
        """``frame.scan(f)``; key ranges of candidate pages reach the scan as pushed filters, so files and row groups of other pages are skipped."""
        k = F.col(self.frame.schema.key)
        near = [(k >= F.lit(a)) & (k <= F.lit(b)) for a, b in self.ranges(f)]
        return self.frame.scan(f).where(reduce(lambda a, b: a | b, near, F.lit(False)))

    def lookup(self, field: str, value: str) -> DataFrame:
        """Pages that have the value."""
        return self.items.where((F.col("field") == field) & (F.col("value") == value)).select("page")

    def save(self, path: str) -> None:
        self.items.repartitionByRange("field", "value").sortWithinPartitions("field", "value", "page").write.parquet(f"{path}/items")
        self.pages.write.parquet(f"{path}/pages")
        self.frame.df.sparkSession.createDataFrame([(self.checksum,)], "checksum long").write.parquet(f"{path}/checksum")

    @classmethod
    def load(cls, frame: TrailFrame, path: str) -> PageIndex:
        spark = frame.df.sparkSession
        kept = spark.read.parquet(f"{path}/checksum").first()[0]
        if kept != cls.checksum_of(frame):
            raise InvalidIndex("the index belongs to other data")
        return cls(frame, spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/pages"), kept)
