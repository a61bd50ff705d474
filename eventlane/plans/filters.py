"""Event filters in conjunctive normal form, compiled to one Catalyst predicate.

A filter is an AND of clauses, a clause an OR of terms.  An empty clause is
false.  Values are strings; ``''`` is the empty value, equal only to itself, so
``f != x`` also holds where ``f`` is empty.  A term on an unknown field, and on
``time`` as a field, never matches, and always matches when negated.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlane.errors import BadFilter, IncorrectTermType, InvalidRange, NoSuchItem
from eventlane.plans.schema import TrailSchema

#: Clauses that stay conjuncts of their own, which a scan can push down.
CONJUNCTS = 64
MATCH, TIME_RANGE, UNKNOWN = "match", "time_range", "unknown"


@dataclass(frozen=True)
class Term:
    field: str
    value: str
    negated: bool = False

    def column(self, s: TrailSchema) -> Column:
        if self.field not in s.fields:
            return F.lit(self.negated)
        c = F.col(f"`{self.field}`")
        return c != F.lit(self.value) if self.negated else c == F.lit(self.value)


@dataclass(frozen=True)
class TimeRange:
    start: int
    end: int

    def column(self, s: TrailSchema) -> Column:
        t = F.col(f"`{s.time}`")
        return (t >= F.lit(self.start)) & (t < F.lit(self.end))


class EventFilter:
    """Builder and holder of clauses; a new filter has one empty clause and matches nothing."""

    def __init__(self, clauses=((),), every: bool = False):
        self.clauses: list[list[Term | TimeRange]] = [list(c) for c in clauses]
        self.every = every

    @classmethod
    def match_all(cls) -> EventFilter:
        return cls(every=True)

    @classmethod
    def match_none(cls) -> EventFilter:
        return cls()

    def add_term(self, field: str, value: str = "", negated: bool = False) -> EventFilter:
        self.every = False
        self.clauses[-1].append(Term(field, value, negated))
        return self

    def add_time_range(self, start: int, end: int) -> EventFilter:
        if end <= start:
            raise InvalidRange(f"[{start}, {end})")
        self.every = False
        self.clauses[-1].append(TimeRange(start, end))
        return self

    def new_clause(self) -> EventFilter:
        self.clauses.append([])
        return self

    @property
    def num_clauses(self) -> int:
        return len(self.clauses)

    def num_terms(self, clause: int) -> int:
        if not 0 <= clause < len(self.clauses):
            raise NoSuchItem(f"clause {clause}")
        return len(self.clauses[clause])

    def _term(self, clause: int, term: int) -> Term | TimeRange:
        if not 0 <= term < self.num_terms(clause):
            raise NoSuchItem(f"term {term} of clause {clause}")
        return self.clauses[clause][term]

    def term_type(self, clause: int, term: int) -> str:
        try:
            return MATCH if isinstance(self._term(clause, term), Term) else TIME_RANGE
        except NoSuchItem:
            return UNKNOWN

    def get_item(self, clause: int, term: int) -> tuple[str, str, bool]:
        t = self._term(clause, term)
        if not isinstance(t, Term):
            raise IncorrectTermType(TIME_RANGE)
        return t.field, t.value, t.negated

    def get_time_range(self, clause: int, term: int) -> tuple[int, int]:
        t = self._term(clause, term)
        if not isinstance(t, TimeRange):
            raise IncorrectTermType(MATCH)
        return t.start, t.end

    def column(self, s: TrailSchema) -> Column:
        """One predicate over the columns of ``s``."""
        if self.every:
            return F.lit(True)
        if any(not c for c in self.clauses):
            return F.lit(False)
        own = list({tuple(c): c for c in self.clauses}.values())
        clauses = [_either(_together(c, s)) for c in own[:CONJUNCTS]]
        if len(own) > CONJUNCTS:
            clauses.append(_counted(own[CONJUNCTS:], s))
        return reduce(lambda a, b: a & b, clauses)

    def __str__(self) -> str:
        """The clauses as text, for a trace."""
        if self.every:
            return "everything"
        show = lambda t: f"{t.field}{'!' if t.negated else ''}={t.value}" if isinstance(t, Term) else f"[{t.start}, {t.end})"
        return " & ".join(" ".join(map(show, c)) or "nothing" for c in self.clauses)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, EventFilter) and (self.clauses, self.every) == (other.clauses, other.every)

    __hash__ = None


def _together(clause, s: TrailSchema) -> list[Column]:
    """The terms of a clause as columns, equality terms on one field as one list."""
    values: dict[str, list[str]] = {}
    out = []
    for t in clause:
        if isinstance(t, Term) and not t.negated and t.field in s.fields:
            values.setdefault(t.field, []).append(t.value)
        else:
            out.append(t.column(s))
    return [*(F.col(f"`{f}`").isin(v) if len(v) > 1 else Term(f, v[0]).column(s) for f, v in values.items()), *out]


def _counted(clauses, s: TrailSchema) -> Column:
    """Very many clauses as tables instead of expressions: how many of them hold is looked up by each field's value.

    A plan grows with the fields, not with the clauses; the tables are constants,
    and a value is found by its hash.  Where one field alone makes all clauses
    hold, or all fields together too few, that decides; else the clauses that hold
    are put together.
    """
    equal: dict[str, dict[str, list[int]]] = {}
    unequal: dict[str, dict[str, list[int]]] = {}
    ranges: list[tuple[int, int, int]] = []
    n = 0
    for c in clauses:
        known = [t for t in c if isinstance(t, TimeRange) or t.field in s.fields]
        barred = {(t.field, t.value) for t in known if isinstance(t, Term) and t.negated}
        fields = {f for f, _ in barred}
        if any(isinstance(t, Term) and t.negated and t.field not in s.fields for t in c) or len(barred) > len(fields) or any(isinstance(t, Term) and not t.negated and (t.field, t.value) in barred for t in known):
            continue  # always true
        for t in {t: None for t in known}:
            if isinstance(t, TimeRange):
                ranges.append((n, t.start, t.end))
            elif t.negated or t.field not in fields:  # beside f != x, f = y says nothing more
                (unequal if t.negated else equal).setdefault(t.field, {}).setdefault(t.value, []).append(n)
        n += 1
    counts, parts = [], []
    for f in dict.fromkeys([*equal, *unequal]):
        e, u = equal.get(f, {}), unequal.get(f, {})
        every = sorted(c for x in u.values() for c in x)
        c = F.col(f"`{f}`")
        counts.append(_found(c, {v: len(e.get(v, ())) + len(every) - len(u.get(v, ())) for v in {**e, **u}}, "int", F.lit(len(every))))
        none = F.array().cast("array<int>")
        parts += [_found(c, e, "array<int>", none)] if e else []
        parts += [F.array_except(_constant(every, "array<int>"), _found(c, u, "array<int>", none))] if u else []
    if ranges:
        time = F.col(f"`{s.time}`")
        counts.append(_holding(time, ranges))
        held = F.filter(_constant([{"c": c, "a": a, "b": b} for c, a, b in ranges], "array<struct<c:int,a:long,b:long>>"), lambda r: (time >= r["a"]) & (time < r["b"]))
        parts.append(F.transform(held, lambda r: r["c"]))
    if not parts:
        return F.lit(n == 0)
    one = reduce(lambda a, b: a | b, [c == n for c in counts])
    few = reduce(lambda a, b: a + b, counts) < n
    return F.when(one, True).when(few, False).otherwise(F.size(F.array_distinct(F.concat(*parts))) == n)


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _found(c: Column, table: dict, kind: str, default: Column) -> Column:
    """What ``table`` has for the string ``c``: one look at a list of small maps, by a hash of the string."""
    size = max(1, len(table))
    maps: list[dict] = [{} for _ in range(size)]
    for v, x in table.items():
        maps[zlib.crc32(v.encode("utf-8", "replace")) % size][v] = x
    c = c.cast("string")
    at = (F.crc32(c.cast("binary")) % size).cast("int")
    return F.coalesce(F.try_element_at(F.get(_constant(maps, f"array<map<string,{kind}>>"), at), c), default)


def _holding(time: Column, ranges: list[tuple[int, int, int]]) -> Column:
    """How many clauses have a range with the time: a search in halves of the times where that number changes."""
    change: dict[int, int] = {}
    last = None
    for c, a, b in sorted(ranges):  # ranges of one clause that overlap count once
        if last and last[0] == c and a <= last[2]:
            last[2] = max(last[2], b)
            continue
        if last:
            change[last[1]], change[last[2]] = change.get(last[1], 0) + 1, change.get(last[2], 0) - 1
        last = [c, a, b]
    change[last[1]], change[last[2]] = change.get(last[1], 0) + 1, change.get(last[2], 0) - 1
    times = sorted(change)
    held = [0, *accumulate(change[t] for t in times)]
    steps = _constant([1 << k for k in reversed(range(len(times).bit_length()))], "array<int>")
    bounds = _constant(times, "array<long>")
    at = F.aggregate(steps, F.lit(0), lambda x, y: F.when(F.coalesce(F.get(bounds, x + y - 1) <= time, F.lit(False)), x + y).otherwise(x))
    return F.get(_constant(held, "array<int>"), at)


def _either(columns: list[Column]) -> Column:
    """Terms OR-ed in halves, so that very long clauses stay shallow."""
    while len(columns) > 1:
        columns = [columns[i] | columns[i + 1] if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    return columns[0]


def parse(text: str, read: Callable[[str], str] | None = None) -> EventFilter:
    """A filter from ``"a=x & b=y c!= d=@file"``.

    White space (space, newline, tab) separates terms, which are OR-ed; a token
    ``&`` starts the next clause.  The first ``=`` splits a term, ``!`` before it
    negates; a value ``@path`` is the content of a file, every byte of it.  A
    token that only starts with ``&`` is refused, as its rest would be lost.
    """

    def content(path: str) -> str:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()

    read = read or content
    out = EventFilter()
    for token in text.replace("\n", " ").replace("\t", " ").split(" "):
        if not token:
            continue
        if token.startswith("&"):
            if token != "&":
                raise BadFilter(f"{token!r}: put white space after '&'")
            out.new_clause()
            continue
        field, eq, value = token.partition("=")
        if not eq:
            raise BadFilter(f"{token!r}: '=' is missing")
        negated = field.endswith("!")
        out.add_term(field[:-1] if negated else field, read(value[1:]) if value.startswith("@") else value, negated)
    return out
