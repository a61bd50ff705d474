"""``TrailFrame``: a table of events that form trails, with options, scans, aggregates and windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlane.errors import DiffWithFilter, HandleClosed, InvalidKey, InvalidOption, InvalidOptionValue, InvalidTrailId, NoSuchItem, UnknownField, UnknownKey
from eventlane.functions.items import item_field, item_value, pack_item
from eventlane.functions.keys import key_order, parse_key
from eventlane.operators.ranks import hex_bucket, number_bucket, ordinal, quantile_bucket
from eventlane.plans.filters import EventFilter
from eventlane.plans.schema import TIME_LIMIT, TrailSchema

VERSION = 1
#: Keys that are put into the predicate itself; longer lists are joined.
INLINE_KEYS = 1000
SESSION_GAP = 1800


@dataclass(frozen=True)
class TrailFrame:
    """Events with a key, an integer time, a tie-break and string fields.

    Values are never null: ``of`` turns null into the empty value.  Filters can
    be set for the whole frame, for single trails, and for one scan; the most
    specific one holds alone.
    """

    df: DataFrame
    schema: TrailSchema
    event_filter: EventFilter | None = None
    trail_filters: tuple[tuple[object, EventFilter], ...] = ()
    trail_tables: tuple[tuple[DataFrame, EventFilter | None], ...] = ()
    only_diff: bool = False
    options: dict = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, key: str, time: str, seq: str | Column | None, fields, strings: bool = True) -> TrailFrame:
        """A frame over any table; ``seq`` breaks ties of time (all fields in order if there is none)."""
        fields = tuple(fields)
        schema = TrailSchema(fields)
        value = lambda f: F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) if strings else F.col(f"`{f}`")
        tie = F.lit(0) if seq is None else F.col(seq) if isinstance(seq, str) else seq
        return cls(df.select(F.col(key).alias("trail_key"), F.col(time).cast("long").alias("time"), tie.cast("long").alias("seq"), *[value(f).alias(f) for f in fields]), schema)

    # options and views

    def with_filter(self, f: EventFilter | None) -> TrailFrame:
        """A view; ``None`` clears the filter."""
        return replace(self, event_filter=f)

    def with_trail_filter(self, keys, f: EventFilter | None) -> TrailFrame:
        """The filter of single trails, listed or in the first column of a table of any size; ``None`` removes it."""
        if isinstance(keys, DataFrame):
            return replace(self, trail_tables=(*self.trail_tables, (keys, f)))
        keys = list(dict.fromkeys(keys))
        if self.trail_tables:  # what is given last holds, so the list goes behind the tables
            kind = dict(self.df.dtypes)[self.schema.key]
            return self.with_trail_filter(self.df.sparkSession.createDataFrame([(k,) for k in keys], f"listed {kind}"), f)
        listed = set(keys)
        left = tuple(x for x in self.trail_filters if x[0] not in listed)
        return replace(self, trail_filters=left if f is None else left + tuple((k, f) for k in keys))

    def trail_filter(self, key) -> EventFilter | None:
        for keys, f in reversed(self.trail_tables):
            if not keys.where(F.col(keys.columns[0]) == F.lit(key)).isEmpty():
                return f
        return dict(self.trail_filters).get(key)

    def with_only_diff(self, on: bool = True) -> TrailFrame:
        return replace(self, only_diff=on)

    def set_option(self, name: str, value) -> TrailFrame:
        if name == "event_filter":
            return self.with_filter(value)
        if name == "only_diff_items":
            return self.with_only_diff(bool(value))
        if name == "cursor_event_buffer_size":
            if not value or value < 0:
                raise InvalidOptionValue(name)
            return replace(self, options=self.options | {name: value})
        raise InvalidOption(name)

    def get_option(self, name: str):
        if name == "event_filter":
            return self.event_filter
        if name == "only_diff_items":
            return self.only_diff
        if name == "cursor_event_buffer_size":
            return self.options.get(name, 1000)
        raise InvalidOption(name)

    def close(self) -> None:
        """Frees what is cached; this frame and its views can't be scanned any more."""
        self.options["closed"] = True
        self.df.unpersist()

    def cache(self) -> TrailFrame:
        return replace(self, df=self.df.cache())

    def uncache(self) -> TrailFrame:
        self.df.unpersist()
        return self

    # scans

    def predicate(self, scan_filter: EventFilter | None = None) -> Column:
        """The condition in effect: that of the scan, else of the trail, else of the frame (filters of tables of keys need a join: ``scan``)."""
        if scan_filter is not None:
            return scan_filter.column(self.schema)
        if self.trail_tables:
            raise InvalidOptionValue("trails whose filters are in tables have no predicate")
        base = F.lit(True) if self.event_filter is None else self.event_filter.column(self.schema)
        groups: list[tuple[EventFilter, list]] = []
        for k, f in self.trail_filters:
            same = next((g for g in groups if g[0] == f), None)
            same[1].append(k) if same else groups.append((f, [k]))
        out = None
        for f, keys in groups:
            hit = F.col(self.schema.key).isin(keys)
            out = F.when(hit, f.column(self.schema)) if out is None else out.when(hit, f.column(self.schema))
        return base if out is None else out.otherwise(base)

    def scan(self, scan_filter: EventFilter | None = None) -> DataFrame:
        """Events that pass the filters in effect (in no order: see ``ordered``)."""
        if self.options.get("closed"):
            raise HandleClosed("the frame was closed")
        if self.only_diff and (scan_filter is not None or self.event_filter is not None or self.trail_filters or self.trail_tables):
            raise DiffWithFilter("changed items can't be read through a filter")
        if self.only_diff:
            return self.diff()
        if scan_filter is None and self._many:
            return self._joined_scan()
        return self.df.where(self.predicate(scan_filter))

    @property
    def _many(self) -> bool:
        return bool(self.trail_tables) or len(self.trail_filters) > INLINE_KEYS

    def _joined(self) -> tuple[DataFrame, Column]:
        """Many trail filters: all events with a key-to-filter table joined in (its size is that of a list in this process) and the tables of keys, and the condition in effect."""
        s, base = self.schema, F.lit(True) if self.event_filter is None else self.event_filter.column(self.schema)
        kinds: list[EventFilter] = []
        rows = []
        for k, f in dict(self.trail_filters).items():
            n = next((i for i, g in enumerate(kinds) if g == f), len(kinds))
            if n == len(kinds):
                kinds.append(f)
            rows.append((k, n))
        kind = dict(self.df.dtypes)[s.key]
        table = self.df.sparkSession.createDataFrame(rows, f"filter_key {kind}, filter_no int")
        d = self.df.join(table, F.col(s.key) == F.col("filter_key"), "left")
        c = F.when(F.col("filter_no").isNull(), base)
        for n, f in enumerate(kinds):
            c = c.when(F.col("filter_no") == n, f.column(s))
        for n, (keys, f) in enumerate(self.trail_tables):
            d = d.join(keys.select(F.col(keys.columns[0]).alias(f"table_key_{n}")).distinct(), F.col(s.key) == F.col(f"table_key_{n}"), "left")
            c = F.when(F.col(f"table_key_{n}").isNotNull(), base if f is None else f.column(s)).otherwise(c)
        return d, c

    def _joined_scan(self) -> DataFrame:
        d, hit = self._joined()
        return d.where(hit).select(*self.schema.columns)

    def ordered(self, scan_filter: EventFilter | None = None) -> DataFrame:
        """Events trail by trail, each by time; a trail is in one partition."""
        s = self.schema
        return self.scan(scan_filter).repartition(s.key).sortWithinPartitions(s.key, s.time, s.seq)

    def in_trail_order(self, scan_filter: EventFilter | None = None) -> DataFrame:
        """All events in one order: by trail id, then by time, nulls last (a range-partitioned sort)."""
        s = self.schema
        k = F.col(s.key)
        order = key_order(k) if dict(self.df.dtypes)[s.key] == "string" else k
        return self.scan(scan_filter).orderBy(*[c.asc_nulls_last() for c in (order, F.col(s.time), F.col(s.seq))])

    def trail(self, key, scan_filter: EventFilter | None = None) -> DataFrame:
        """One trail; the key reaches the scan as a pushed filter."""
        s = self.schema
        return self.scan(scan_filter).where(F.col(s.key) == F.lit(key)).orderBy(s.time, s.seq)

    def trail_by_id(self, trail_id: int) -> DataFrame:
        row = self.trail_ids().where(F.col("trail_id") == trail_id).first()
        if row is None:
            raise InvalidTrailId(str(trail_id))
        return self.trail(row["trail_key"])

    def trail_id(self, key) -> int:
        """The id of a trail: its place among the keys in their order.  Only the keys are read, nothing is sorted."""
        k, kind = F.col(self.schema.key), dict(self.df.dtypes)[self.schema.key]
        if kind == "string":
            want = self.df.sparkSession.range(1).select(parse_key(F.lit(key)).alias("k")).first()["k"] if len(str(key)) == 32 else None
            if want is None:
                raise InvalidKey(str(key))
            less = key_order(k) < key_order(F.lit(want))
        else:
            want = key
            less = k < F.lit(key)
        r = self.df.agg(F.countDistinct(F.when(less, k)).alias("n"), F.max(k == F.lit(want)).alias("found")).first()
        if not r["found"]:
            raise UnknownKey(str(key))
        return r["n"]

    def ids_of(self, keys: DataFrame) -> DataFrame:
        """``key`` (the first column of ``keys``) and ``trail_id``, null where there is no such trail."""
        ids = self.trail_ids().withColumnRenamed("trail_key", "own_key")
        k = keys.select(F.col(keys.columns[0]).alias("key"))
        return k.join(ids, F.col("key") == F.col("own_key"), "left").select("key", "trail_id")

    def events(self, key):
        """Iterator over the events of one trail."""
        return self.trail(key).toLocalIterator()

    def peek(self, key):
        return self.trail(key).first()

    def project(self, fields) -> TrailFrame:
        for f in fields:
            if f not in self.schema.fields:
                raise UnknownField(f)
        s = TrailSchema(tuple(fields))
        return TrailFrame(self.scan().select(*s.columns), s)

    def only(self, keys: DataFrame) -> TrailFrame:
        """Whitelist: trails whose key is in the first column of ``keys``."""
        k = keys.select(F.col(keys.columns[0]).alias("listed")).distinct()
        return replace(self, df=self.df.join(k, F.col(self.schema.key) == F.col("listed"), "left_semi"))

    def without(self, keys: DataFrame) -> TrailFrame:
        """Blacklist."""
        k = keys.select(F.col(keys.columns[0]).alias("listed")).distinct()
        return replace(self, df=self.df.join(k, F.col(self.schema.key) == F.col("listed"), "left_anti"))

    def extract(self) -> TrailFrame:
        """A view as a frame of its own: lexicon and trails are those of what is left."""
        return TrailFrame(self.scan(), self.schema)

    def for_each_trail(self, fn: Callable, schema: str) -> DataFrame:
        """Any function of one trail (a pandas frame by time): the way out where no expression will do."""
        s = self.schema
        order = [s.time, s.seq]
        return self.scan().groupBy(s.key).applyInPandas(lambda pdf: fn(pdf.sort_values(order)), schema)

    # metadata and aggregates

    def meta(self) -> DataFrame:
        """One row about all events, filtered or not."""
        s = self.schema
        return self.df.agg(
            F.countDistinct(s.key).alias("num_trails"),
            F.count(F.lit(1)).alias("num_events"),
            F.lit(s.num_fields).cast("long").alias("num_fields"),
            F.min(s.time).alias("min_timestamp"),
            F.max(s.time).alias("max_timestamp"),
            F.lit(VERSION).cast("long").alias("version"),
        )

    def lengths(self, scan_filter: EventFilter | None = None, with_empty: bool = True) -> DataFrame:
        """Events in effect for each trail; trails without any count 0 or are left out."""
        k = self.schema.key
        if with_empty:
            d, hit = self._joined() if scan_filter is None and self._many else (self.df, self.predicate(scan_filter))
            return d.groupBy(k).agg(F.count(F.when(hit, 1)).alias("n"))
        return self.scan(scan_filter).groupBy(k).agg(F.count(F.lit(1)).alias("n"))

    def trails(self) -> DataFrame:
        s = self.schema
        return self.df.groupBy(s.key).agg(F.count(F.lit(1)).alias("n"), F.min(s.time).alias("t_min"), F.max(s.time).alias("t_max"))

    def trail_ids(self) -> DataFrame:
        """``trail_key`` and ``trail_id``: text keys by their little-endian number, integers by value."""
        k = F.col(self.schema.key)
        keys = self.df.select(k.alias("trail_key")).distinct()
        if dict(keys.dtypes)["trail_key"] == "string":
            o = key_order(F.col("trail_key"))
            return ordinal(keys, "trail_id", o, hex_bucket(o))
        low, high = keys.agg(F.min("trail_key"), F.max("trail_key")).first()
        return ordinal(keys, "trail_id", F.col("trail_key"), number_bucket(F.col("trail_key"), low, high))

    def _values(self) -> DataFrame:
        s = self.schema
        pairs = F.array(*[F.struct(F.lit(i + 1).alias("field"), F.col(f"`{f}`").alias("value")) for i, f in enumerate(s.fields)])
        return self.scan().select(F.col(s.seq).alias("seq"), F.explode(pairs).alias("p")).select("seq", "p.field", "p.value")

    def lexicon(self) -> DataFrame:
        """``field``, ``val``, ``value``: distinct non-empty values of each field by first appearance, from 1; 0 is the empty value."""
        spark = self.df.sparkSession
        names = spark.createDataFrame([(i + 1, f) for i, f in enumerate(self.schema.fields)], "field int, field_name string")
        if not self.schema.fields:
            return names.select("field", "field_name", F.lit(0).cast("long").alias("val"), F.lit("").alias("value"))
        first = self._values().where("value <> ''").groupBy("field", "value").agg(F.min("seq").alias("at"))
        # most values appear early: bounds by their own quantiles, found in the pass that aggregates them
        numbered = ordinal(first, "no", F.struct("at", "value"), quantile_bucket(first, "at"), ("field",))
        vals = numbered.select("field", (F.col("no") + 1).alias("val"), "value").unionByName(names.select("field", F.lit(0).cast("long").alias("val"), F.lit("").alias("value")))
        return vals.join(names, "field").select("field", "field_name", "val", "value")

    def lexicon_sizes(self) -> DataFrame:
        """Distinct non-empty values and one, for each field."""
        s = self.schema
        if not s.fields:
            return self.df.sparkSession.createDataFrame([], "field string, size long")
        one = self.scan().agg(*[(F.countDistinct(F.when(F.col(f"`{f}`") != "", F.col(f"`{f}`"))) + 1).alias(f) for f in s.fields])
        return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("size")) for f in s.fields])).alias("x")).select("x.*")

    def item(self, field_name: str, value: str) -> int:
        """Packed item of a value, 0 if the value is unknown."""
        f = self.schema.field_id(field_name)
        if value == "":
            return f
        row = self.lexicon().where((F.col("field") == f) & (F.col("value") == value)).select(pack_item(F.col("field"), F.col("val")).alias("x")).first()
        return row["x"] if row else 0

    def value(self, field_id: int, val: int) -> str | None:
        if val == 0 and self.schema.field_name(field_id) is not None:
            return ""
        row = self.lexicon().where((F.col("field") == field_id) & (F.col("val") == val)).first()
        return row["value"] if row else None

    def items(self) -> DataFrame:
        """``field_name``, ``value`` and packed ``item`` of every value: the lexicon in item form."""
        return self.lexicon().select("field_name", "value", F.when((F.col("val") == 0), F.col("field").cast("long")).otherwise(pack_item(F.col("field"), F.col("val"))).alias("item"))

    def items_of(self, f: str, values: DataFrame) -> DataFrame:
        """``value`` (the first column of ``values``) and its ``item`` in field ``f``; 0 where the field has no such value."""
        self.schema.field_id(f)
        own = self.items().where(F.col("field_name") == f).select(F.col("value").alias("own_value"), "item")
        v = values.select(F.col(values.columns[0]).alias("value"))
        return v.join(own, F.col("value") == F.col("own_value"), "left").select("value", F.coalesce("item", F.lit(0)).alias("item"))

    def item_to_value(self, item: int) -> str:
        """The value of one packed item."""
        r = self.df.sparkSession.range(1).select(item_field(F.lit(item).cast("long")).cast("int").alias("f"), item_value(F.lit(item).cast("long")).alias("v")).first()
        value = self.value(r["f"], r["v"])
        if value is None:
            raise NoSuchItem(str(item))
        return value

    def values_of(self, items: DataFrame) -> DataFrame:
        """``item`` (the first column of ``items``) with its ``field_name`` and ``value``; null where there is none."""
        own = self.items().withColumnRenamed("item", "own_item")
        i = items.select(F.col(items.columns[0]).cast("long").alias("item"))
        return i.join(own, F.col("item") == F.col("own_item"), "left").select("item", "field_name", "value")

    def encoded(self, scan_filter: EventFilter | None = None) -> DataFrame:
        """Events with each field as its packed item: one join with the lexicon for each field."""
        s = self.schema
        d, own = self.scan(scan_filter), self.items()
        for n, f in enumerate(s.fields):
            mine = own.where(F.col("field_name") == f).select(F.col("value").alias(f"value {n}"), F.col("item").alias(f"item {n}"))
            d = d.join(mine, F.col(f"`{f}`") == F.col(f"`value {n}`"), "left").drop(f"value {n}")
        return d.select(s.key, s.time, s.seq, *[F.col(f"`item {n}`").alias(f) for n, f in enumerate(s.fields)])

    def item_total(self, fields=None) -> int:
        """Items that decoding these fields (all, if none are named) gives: one for each event and field."""
        names = list(self.schema.fields if fields is None else fields)
        for f in names:
            self.schema.field_id(f)
        return self.scan().count() * len(names)

    def hex_dump(self) -> DataFrame:
        """``trail_key``, ``time`` and ``bytes``: the values of each event as hex, a separator 00 between them."""
        s = self.schema
        raw = F.concat_ws("\u0000", *[F.col(f"`{f}`") for f in s.fields])
        return self.scan().select(s.key, s.time, s.seq, F.lower(F.hex(F.encode(raw, "UTF-8"))).alias("bytes"))

    def distinct_per_trail(self, f: str) -> DataFrame:
        return self.scan().groupBy(self.schema.key).agg(F.countDistinct(F.col(f"`{f}`")).alias("n"))

    def item_counts(self) -> DataFrame:
        """Events by field and value."""
        names = F.element_at(F.array(*[F.lit(f) for f in self.schema.fields]), F.col("field"))
        return self._values().groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).select(names.alias("field"), "value", "n")

    def item_pair_counts(self, a: str, b: str) -> DataFrame:
        """Events by the values of two fields together."""
        return self.scan().groupBy(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).agg(F.count(F.lit(1)).alias("n"))

    # windows

    @property
    def window(self):
        return Window.partitionBy(self.schema.key).orderBy(self.schema.time, self.schema.seq)

    def diff(self) -> DataFrame:
        """Only what changed: a field is null where it equals the event before; ``num_items`` counts the others."""
        s, w = self.schema, self.window
        d = self.df
        for f in s.fields:
            d = d.withColumn(f"changed {f}", F.coalesce(F.lag(F.col(f"`{f}`")).over(w) != F.col(f"`{f}`"), F.lit(True)))
        count = reduce(lambda a, b: a + b, [F.col(f"`changed {f}`").cast("int") for f in s.fields], F.lit(0))
        return d.select(s.key, s.time, s.seq, *[F.when(F.col(f"`changed {f}`"), F.col(f"`{f}`")).alias(f) for f in s.fields], count.alias("num_items"))

    def undiff(self, d: DataFrame) -> DataFrame:
        """The inverse of ``diff``: the last value is carried forward."""
        w = self.window.rowsBetween(Window.unboundedPreceding, 0)
        s = self.schema
        return d.select(s.key, s.time, s.seq, *[F.last(F.col(f"`{f}`"), ignorenulls=True).over(w).alias(f) for f in s.fields])

    def nested(self) -> DataFrame:
        """One row a trail with its events as an array by time."""
        s = self.schema
        return self.scan().groupBy(s.key).agg(F.sort_array(F.collect_list(F.struct(s.time, s.seq, *s.fields))).alias("events"))

    def deltas(self) -> DataFrame:
        """Time since the event before; of a first event, since the least time of all."""
        s = self.schema
        start = self.df.agg(F.min(s.time)).first()[0]
        return self.df.select(s.key, s.time, s.seq, (F.col(s.time) - F.lag(s.time, 1, start).over(self.window)).alias("delta"))

    def too_large(self) -> DataFrame:
        """Events whose time can't be kept: it, or its distance to the event before, reaches the limit."""
        if self.df.agg(F.min(self.schema.time)).first()[0] is None:
            return self.deltas_empty()
        d = self.deltas()
        least = d.agg(F.min("time")).first()[0]
        return d.where((F.col("delta") >= TIME_LIMIT) | F.lit(least >= TIME_LIMIT) | (F.col("time") < 0))

    def deltas_empty(self) -> DataFrame:
        s = self.schema
        return self.df.select(s.key, s.time, s.seq, F.lit(0).cast("long").alias("delta")).limit(0)

    def session_index(self, gap: int = SESSION_GAP) -> DataFrame:
        """Events with their session from 1; a gap longer than ``gap`` starts one, an equal gap doesn't."""
        s, w = self.schema, self.window
        new = F.when(F.col(s.time) - F.lag(s.time).over(w) > gap, 1).otherwise(0)
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        return self.scan().withColumn("new_session", new).withColumn("session", (F.sum("new_session").over(running) + 1).cast("long")).drop("new_session")

    def sessions(self, gap: int = SESSION_GAP) -> DataFrame:
        """Sessions and events of each trail: one shuffle, for the window and the sum."""
        k = self.schema.key
        return self.session_index(gap).groupBy(k).agg(F.max("session").alias("sessions"), F.count(F.lit(1)).alias("events"))

    def session_stats(self, gap: int = SESSION_GAP) -> DataFrame:
        s = self.schema
        return self.session_index(gap).groupBy(s.key, "session").agg(F.count(F.lit(1)).alias("events"), F.min(s.time).alias("t_min"), F.max(s.time).alias("t_max"))
