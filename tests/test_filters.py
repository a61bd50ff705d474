"""Filter semantics on the small fixtures, and against a plain evaluator."""

import random

import pytest

from eventlane import errors
from eventlane.operators import PageIndex, TrailFrame, append, merge, multi_merge
from eventlane.plans.filters import MATCH, TIME_RANGE, UNKNOWN, EventFilter, Term, parse
from eventlane.plans.schema import TrailSchema, check_fields

ROWS = [(1, "foo", "bar", ""), (2, "foo", "sun", ""), (3, "foo", "run", ""), (4, "", "sun", "nam")]


@pytest.fixture(scope="module")
def small(spark):
    d = spark.createDataFrame([("0" * 32, t, i, a, b, c) for i, (t, a, b, c) in enumerate(ROWS)], "k string, t long, s long, a string, b string, c string")
    return TrailFrame.of(d, "k", "t", "s", ("a", "b", "c")).cache()


def test_filter_counts(small):
    a, b, c = (lambda v, n=False, f=f: (f, v, n) for f in "abc")

    def f(*clauses):
        out = EventFilter()
        for i, clause in enumerate(clauses):
            if i:
                out.new_clause()
            for t in clause:
                out.add_term(*t)
        return out

    cases = [(f([]), 0), (f([a("foo")]), 3), (f([a("foo"), b("sun")]), 4), (f([c("")]), 3), (f([c("")] + [a("foo")] * 1000), 3), (f([a("foo", True)]), 1), (f([c("", True)]), 1), (f([b("sun", True), a("foo")]), 3), (f([a("foo")], []), 0), (f([b("sun")], [c("nam")]), 1), (f([b("sun")], [c("nam"), a("")]), 1), (f([a("foo")], [b("bar")], [c("")]), 1), (f([("z", "x")]), 0), (f([("z", "x"), ("z", "x", True)]), 4), (EventFilter.match_all(), 4), (EventFilter.match_none(), 0)]
    for flt, n in cases:
        assert small.scan(flt).count() == n, flt.clauses
    assert small.with_filter(EventFilter()).with_filter(None).scan().count() == 4


def test_time_ranges(small):
    r = lambda *x: EventFilter().add_time_range(*x)
    for f, n in ((r(0, 5), 4), (r(0, 4), 3), (r(1, 5), 4), (r(2, 3), 1), (r(1, 3), 2), (r(3, 5), 2), (r(1, 2).add_time_range(4, 5), 2), (r(1, 2).new_clause().add_time_range(4, 5), 0)):
        assert small.scan(f).count() == n
    for x in ((1, 1), (4, 1)):
        with pytest.raises(errors.InvalidRange):
            r(*x)


def test_random_filters_match_a_plain_evaluator(small):
    rng = random.Random(1)
    for _ in range(15):
        clauses = [[Term(rng.choice("abcz"), rng.choice(["foo", "sun", "", "q"]), rng.random() < 0.4) for _ in range(rng.randint(0 if rng.random() < 0.1 else 1, 3))] for _ in range(rng.randint(1, 3))]

        def holds(row):
            v = dict(zip("abc", row[1:], strict=True))
            term = lambda t: t.negated if t.field not in v else (v[t.field] == t.value) != t.negated
            return all(any(term(t) for t in c) for c in clauses)

        assert small.scan(EventFilter(clauses)).count() == sum(map(holds, ROWS))


def test_parser_and_introspection():
    f = parse("a=x & b=y b!=z\tc=\n& d=p=q")
    assert f.num_clauses == 3 and f.num_terms(1) == 3
    assert f.get_item(1, 1) == ("b", "z", True) and f.get_item(2, 0) == ("d", "p=q", False)
    assert f.term_type(0, 0) == MATCH and f.term_type(0, 5) == UNKNOWN
    assert parse("a=@f", read=lambda p: f"[{p}]\n").get_item(0, 0)[1] == "[f]\n"
    for bad in ("a", "a=1 &b=1"):
        with pytest.raises(errors.BadFilter):
            parse(bad)
    g = EventFilter().add_time_range(1, 2)
    assert g.term_type(0, 0) == TIME_RANGE and g.get_time_range(0, 0) == (1, 2)
    with pytest.raises(errors.IncorrectTermType):
        g.get_item(0, 0)
    with pytest.raises(errors.NoSuchItem):
        g.num_terms(1)


def test_names():
    with pytest.raises(errors.DuplicateFields):
        check_fields(["time", "time"])
    for bad in ("time", "", "a b", "x" * 512):
        with pytest.raises(errors.InvalidFieldName):
            check_fields([bad])
    s = TrailSchema(("a", "b"))
    assert s.num_fields == 3 and s.field_id("time") == 0 and s.field_id("b") == 2 and s.field_name(9) is None


def test_cascade_diff_and_views(spark):
    d = spark.createDataFrame([(i, 0, j, "first" if j == 0 else "second") for i in range(50) for j in range(3)], "k long, t long, s long, a string")
    e = TrailFrame.of(d, "k", "t", "s", ("a",))
    one = EventFilter().add_term("a", "first")
    v = e.with_filter(EventFilter.match_none()).with_trail_filter([3], one)
    assert v.scan().count() == 1 and v.scan(EventFilter.match_all()).count() == 150
    assert v.with_trail_filter([3], None).scan().count() == 0 and v.trail_filter(3) == one
    assert e.with_trail_filter(range(20), one)._joined_scan().count() == 20 + 90
    with pytest.raises(errors.DiffWithFilter):
        e.with_only_diff().scan(one)
    assert e.diff().selectExpr("sum(num_items)").first()[0] == 100
    assert {r["n"] for r in e.with_filter(one).lengths().collect()} == {1}
    assert e.with_filter(one).extract().lexicon_sizes().first()["size"] == 2


def test_empty_trails_count_zero_with_many_filters(spark):
    rows = [(i, t, i % 7 if t else 0) for i in range(1300) for t in range(3)]
    e = TrailFrame.of(spark.createDataFrame(rows, "k long, t long, v long"), "k", "t", None, ["v"])
    some, none = (EventFilter().add_term("v", x) for x in ("3", "no"))
    for n in (1000, 1001, 1200):  # filters in the predicate, and joined
        f = e.with_trail_filter(range(n - 1), some).with_trail_filter([n - 1], none)
        want = {i: sum(str(v) == "3" for k, _, v in rows[3 * i : 3 * i + 3]) if i < n - 1 else 0 if i == n - 1 else 3 for i in range(1300)}
        assert {r["trail_key"]: r["n"] for r in f.lengths().collect()} == want
        assert {r["trail_key"]: r["n"] for r in f.lengths(with_empty=False).collect()} == {k: x for k, x in want.items() if x}
        assert {r["trail_key"]: r["n"] for r in f.lengths(none).collect()} == dict.fromkeys(range(1300), 0)


def test_append_merge_and_cursors(spark):
    of = lambda rows, *f: TrailFrame.of(spark.createDataFrame(rows, "k string, t long, s long, " + ", ".join(f"{x} string" for x in f)), "k", "t", "s", f)
    a, b = of([("x", 5, 0, "a", "1"), ("x", 20, 1, "c", "2")], "f1", "f2"), of([("x", 10, 0, "b", "2")], "f1", "f2")
    both = append(a, b)
    assert [r["f1"] for r in both.trail("x").collect()] == ["a", "b", "c"]
    other = of([("x", 7, 0, "z", "q")], "f2", "f3")
    with pytest.raises(errors.FieldsMismatch):
        append(a, other)
    m = merge([a, other])
    assert m.schema.fields == ("f1", "f2", "f3") and m.scan(EventFilter().add_term("f1", "")).count() == 1
    assert [r["cursor_idx"] for r in multi_merge([a, b]).orderBy("position").collect()] == [0, 1, 0]


def test_index_changes_nothing(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([(f"{i % 40:032x}", i, i, rng.choice("abc"), str(i % 7)) for i in range(400)], "k string, t long, s long, p string, q string")
    e = TrailFrame.of(d, "k", "t", "s", ("p", "q"))
    idx = PageIndex.build(e, 10)
    for text in ("p=a & q=1 q=2", "p!=a & q=3", "p=nosuch", "z=1", "p=a p=b & q=0"):
        f = parse(text)
        assert sorted(map(tuple, idx.scan(f).collect())) == sorted(map(tuple, e.scan(f).collect()))
    assert idx.candidates(EventFilter().add_time_range(0, 5)).count() == idx.pages.select("page").distinct().count()
