"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance by one more component
(``sqrt(M^2 - |x|^2)`` for rows, 0 for queries, M the largest norm).  Each of a
few tables cuts ``width`` Gaussian projections into cells.  A query visits its
own bucket and perturbed ones in the order of their estimated success (the sum
of squared distances to the crossed cell borders), the candidates of all tables
are merged and ranked by exact inner products in double precision.

The number of probes is the least that reaches the recall asked for, measured
for a bounded sample of queries against all rows.  Every row is indexed.  Equal
vectors are collapsed to the ids that can still be among the nearest, so a
vector that a third of all rows share is one candidate.  A crowded part of a
table is dealt into several groups of bounded size, and so are the queries that
visit it.

The rows are searched in levels, each about ``STEP`` times as large as all
before it (by a hash of the vector).  From the second level on a query brings
the score that it has to beat, so a level adds some ``TOP * STEP`` rows a query,
however many groups it visits.  Queries with too few candidates are answered
exactly, in blocks against all rows; so are all queries where no number of
probes reaches the recall.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlane.llm.graph import cut

TOP, TABLES, WIDTH, CELL, REACH = 20, 3, 4, 1.5, 2
#: Queries of the sample (those whose keys hash lowest); recall to reach on it.
SAMPLE_QUERIES, RECALL = 256, 0.95
#: Bytes of the vectors in a group of a table, and of the queries that it meets at once.
GROUP_BYTES = 8 << 20
STEP = 4
_NEVER = 1 << 30


class Hashes:
    """Projections of each table, and the probes."""

    def __init__(self, dim: int, norm: float, tables=TABLES, width=WIDTH, cell=CELL, reach=REACH, seed=5):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dim + 1, width))
        self.b = rng.uniform(0, 1, (tables, width))
        self.norm, self.cell, self.reach = norm, cell * norm, reach
        self.moves = np.array(list(product(range(-reach, reach + 1), repeat=width)), np.int64)
        self.probes = len(self.moves)

    def _at(self, x, k, query):
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.norm**2 - (x**2).sum(1)))
        return np.hstack([x, more[:, None]]) @ self.a[k] / self.cell + self.b[k]

    @staticmethod
    def code(cells: np.ndarray) -> np.ndarray:
        """One number for the cells of a bucket (cells beyond +-2^14 share those at the border)."""
        out = np.zeros(cells.shape[:-1], np.int64)
        for j in range(cells.shape[-1]):
            out = (out << 15) | (np.clip(cells[..., j], -(1 << 14), (1 << 14) - 1) + (1 << 14))
        return out

    def rows(self, x, k):
        return self.code(np.floor(self._at(x, k, False)).astype(np.int64))

    def _order(self, x, k):
        """Cell of each query, and the moves from it, most promising first."""
        at = self._at(x, k, True)
        cell = np.floor(at).astype(np.int64)
        f = (at - cell)[:, :, None]
        step = np.arange(-self.reach, self.reach + 1)
        over = np.where(step > 0, step - f, np.where(step < 0, f - step - 1, 0)) ** 2
        cost = sum(over[:, j, self.moves[:, j] + self.reach] for j in range(self.moves.shape[1]))
        return cell, np.argsort(cost, axis=1, kind="stable")

    def visits(self, x, k):
        """Buckets of each query, most promising first."""
        cell, best = self._order(x, k)
        return self.code(cell[:, None, :] + self.moves[best[:, : self.probes]])

    def ranks(self, queries):
        """A function of rows and of each one's query (a place in ``queries``): the first probe of any table that finds the row."""
        tables = []
        for k in range(len(self.a)):
            cell, best = self._order(queries, k)
            tables.append((cell, np.argsort(best, axis=1)))
        wide, power = 2 * self.reach + 1, (2 * self.reach + 1) ** np.arange(self.moves.shape[1])[::-1]

        def of(x, who):
            first = np.full(len(x), _NEVER)
            for k, (cell, rank) in enumerate(tables):
                move = np.floor(self._at(x, k, False)).astype(np.int64) - cell[who] + self.reach
                near = ((move >= 0) & (move < wide)).all(1)
                first[near] = np.minimum(first[near], rank[who[near], (move[near] * power).sum(1)])
            return first

        return of


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of the rows that take part: not null, no null or non-finite component, not zero, an id."""
    v = vectors["embedding"].cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = vectors["vec_id"].isNotNull() & v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(vectors["vec_id"].cast("long").alias("vec_id"), F.transform(v, lambda x: x + 0.0).alias("v"))


def calibrate(hashes: Hashes, distinct: DataFrame, top: int, recall: float, queries: int = SAMPLE_QUERIES) -> float:
    """Sets the least number of probes that finds this share of the nearest of sampled queries among all rows; the share reached (all probes, if none is enough)."""
    asked = distinct.select("h1", "h2", "v").orderBy("h1", "h2").limit(queries).collect()
    x, name = np.array([r["v"] for r in asked]), np.array([(r["h1"], r["h2"]) for r in asked])
    rank = hashes.ranks(x)

    def best(batches):
        who, score, first = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for b in batches:
            y = _matrix(b.column(2))
            s = x @ y.T
            h1, h2 = (b.column(j).to_numpy() for j in (0, 1))
            s[(h1[None, :] == name[:, :1]) & (h2[None, :] == name[:, 1:])] = -np.inf
            if s.shape[1] > top:
                edge = np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top, None]
                q, m = np.nonzero((s >= edge) & (s > -np.inf))
            else:
                q, m = np.nonzero(s > -np.inf)
            who, score, first = np.append(who, q), np.append(score, s[q, m]), np.append(first, rank(y[m], q))
            order = np.lexsort((first, -score, who))
            who, score, first = who[order], score[order], first[order]
            keep = np.arange(len(who)) - np.searchsorted(who, who) < top
            who, score, first = who[keep], score[keep], first[keep]
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(score), pa.array(first)], ["who", "score", "first"])

    near = Window.partitionBy("who").orderBy(F.desc("score"), "first")
    found = distinct.select("h1", "h2", "v").mapInArrow(best, "who long, score double, first long").withColumn("n", F.row_number().over(near)).where(F.col("n") <= top)
    first = np.sort(np.array([r["first"] for r in found.select("first").collect()], np.int64))
    if not len(first):
        return 1.0
    hashes.probes = int(min(len(hashes.moves), first[int(np.ceil(recall * len(first))) - 1] + 1))
    return float((first < hashes.probes).mean())


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP, recall: float = RECALL, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (inner product): each query's nearest found.

    ``vectors`` has ``vec_id`` and ``embedding``; queries are the rows where
    ``is_query`` (a condition on ``vec_id``) holds, candidates all rows but the
    query's own id.  Ties go to the smaller id.  Each query has ``top`` rows, or
    all candidates if there are fewer.  Vectors that are null, zero, hold a null
    or non-finite component, or differ in length from the most frequent length
    (the smaller of equally frequent ones) take no part.  Rows repeated with id
    and vector count once.  Columns of other names are ignored.  No usable rows
    give no rows.
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, most = sizes["dim"], top + 1
    rows = rows.where(F.size("v") == dim).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")})
    few = Window.partitionBy("h1", "h2").orderBy("vec_id")
    ids = rows.dropDuplicates(["h1", "h2", "vec_id"]).withColumn("n", F.row_number().over(few)).where(F.col("n") <= most)
    asked = rows.groupBy("h1", "h2").agg(F.max(F.when(is_query, 1).otherwise(0)).alias("asked"))
    distinct = ids.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = cut(distinct.join(asked, ["h1", "h2"]).select("h1", "h2", "v", "ids", "asked"))
    total = distinct.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).first()
    hashes = Hashes(dim, sizes["norm"])
    reached = calibrate(hashes, distinct, top, recall)
    group = max(64, group_bytes // (8 * dim))
    search = Search(hashes, most, group)

    found = distinct.where("false").select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("h1").alias("m1"), F.col("h2").alias("m2"), F.lit(0.0).alias("score"), "ids")
    if reached >= recall:
        left, cuts = total["n"], []
        while left > group:
            left /= STEP
            cuts.append(left / total["n"])
        place = F.pmod(F.xxhash64("h1", "h2", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
        low = 0.0
        for high in [*cuts[::-1], 1.0]:
            level = distinct.where((place >= low) & (place < high))
            found = search.level(distinct.where("asked = 1"), level, max(1, round(total["n"] * (high - low) / group)), found)
            low = high
    have = found.groupBy("q1", "q2").agg(F.sum(F.size("ids")).alias("have"))
    short = distinct.where("asked = 1").join(have, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")), "left").where(F.coalesce("have", F.lit(0)) < min(most, total["ids"]))
    short = cut(short.select("h1", "h2", "v"))
    if not short.isEmpty():
        found = search.every(short, distinct, max(1, -(-total["n"] // group)), found)
    each = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    found = found.select("q1", "q2", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(each)).where(F.col("n") <= most)
    lists = found.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    asking = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    out = asking.join(lists, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2"))).select("query_id", F.posexplode(near).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


class Search:
    """Queries against the rows of one level, group by group."""

    def __init__(self, hashes: Hashes, most: int, group: int):
        self.hashes, self.most, self.group = hashes, most, group

    def level(self, queries, members, groups, found):
        """``found`` with what the probes find among ``members``."""
        hashes = self.hashes

        def index(batches):
            for b in batches:
                x = _matrix(b.column(2))
                for k in range(len(hashes.a)):
                    code = hashes.rows(x, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k), pa.int32()), pa.array(code % 1_000_003 % groups, pa.int32()), pa.array(code, pa.int64()), *(b.column(j) for j in range(4))], ["part", "slab", "code", "h1", "h2", "v", "ids"])

        def probe(batches):
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    c = b.slice(at, 256)
                    x = _matrix(c.column(2))
                    for k in range(len(hashes.a)):
                        code = hashes.visits(x, k)
                        slab = code % 1_000_003 % groups
                        order = np.argsort(slab, axis=1, kind="stable")
                        slab, code = np.take_along_axis(slab, order, 1), np.take_along_axis(code, order, 1)
                        new = np.concatenate([np.ones((len(x), 1), bool), slab[:, 1:] != slab[:, :-1]], axis=1)
                        start = np.flatnonzero(new.ravel())
                        who = start // slab.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), k), pa.int32()), pa.array(slab.ravel()[start], pa.int32()), pa.ListArray.from_arrays(pa.array(np.append(start, slab.size), pa.int32()), pa.array(code.ravel(), pa.int64())), *(c.column(j).take(pa.array(who)) for j in range(4))], ["part", "slab", "codes", "h1", "h2", "v", "bound"])

        rows = members.select("h1", "h2", "v", "ids").mapInArrow(index, "part int, slab int, code long, h1 long, h2 long, v array<double>, ids array<long>")
        asks = self._bounds(queries, found).mapInArrow(probe, "part int, slab int, codes array<long>, h1 long, h2 long, v array<double>, bound double")
        return self._run(rows, asks, found)

    def every(self, queries, members, groups, found):
        """``found`` with what exact search finds: all rows, dealt by their keys."""
        rows = members.select(F.lit(0).alias("part"), F.pmod("h2", F.lit(groups)).cast("int").alias("slab"), F.lit(0).cast("long").alias("code"), "h1", "h2", "v", "ids")
        slabs = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        asks = self._bounds(queries, found).select(F.lit(0).alias("part"), slabs.alias("slab"), F.array(F.lit(0).cast("long")).alias("codes"), *[F.col(c).alias(c) for c in ("h1", "h2", "v")], "bound")
        return self._run(rows, asks, found)

    def _bounds(self, queries, found):
        """``h1``, ``h2``, ``v`` of the queries, and the last of their best scores (null while there are fewer)."""
        last = found.groupBy("q1", "q2").agg(F.when(F.count(F.lit(1)) >= self.most, F.min("score")).alias("bound"))
        return queries.select("h1", "h2", "v").join(last, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")), "left").select("h1", "h2", "v", "bound")

    def _run(self, rows, asks, found):
        """The best of ``found`` and of what the groups find; groups of bounded size on both sides."""
        many = lambda d, n: d.groupBy("part", "slab").agg(F.count(F.lit(1)).alias(n))
        parts = lambda n: F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(n), F.lit(0)) / self.group)).cast("int")
        counts = many(rows, "n").join(many(asks, "m"), ["part", "slab"]).select(F.col("part").alias("p"), F.col("slab").alias("s"), parts("n").alias("salts"), parts("m").alias("turns"))
        counts = cut(counts)
        on = (F.col("part") == F.col("p")) & (F.col("slab") == F.col("s"))
        dealt = lambda k, n: F.pmod(F.xxhash64("h2", F.lit(k)), F.col(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = rows.join(counts, on).withColumn("salt", dealt(3, "salts")).withColumn("turn", all_of("turns")).drop("p", "s", "salts", "turns")
        asks = asks.join(counts, on).withColumn("turn", dealt(5, "turns")).withColumn("salt", all_of("salts")).drop("p", "s", "salts", "turns")
        by = lambda d: d.groupBy("part", "slab", "salt", "turn")
        new = by(asks).cogroup(by(rows)).applyInArrow(lambda key, q, m: self.search(q, m), "q1 long, q2 long, m1 long, m2 long, score double, ids array<long>")
        best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("ids")[0])
        new = found.unionByName(new).groupBy("q1", "q2", "m1", "m2").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
        return cut(new.withColumn("n", F.row_number().over(best)).where(F.col("n") <= self.most).drop("n"))

    def search(self, q, m):
        if not q.num_rows or not m.num_rows:
            return pa.table({"q1": pa.array([], pa.int64()), "q2": pa.array([], pa.int64()), "m1": pa.array([], pa.int64()), "m2": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        x, y = _matrix(q.column("v")), _matrix(m.column("v"))
        code, place = np.unique(m.column("code").to_numpy(), return_inverse=True)
        codes = q.column("codes").combine_chunks()
        who = np.repeat(np.arange(len(x)), np.diff(codes.offsets.to_numpy()))
        flat = codes.flatten().to_numpy()
        at = np.minimum(np.searchsorted(code, flat), len(code) - 1)
        hit = np.flatnonzero(code[at] == flat)
        who, at = who[hit], at[hit]
        bound = q.column("bound").combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
        bound = np.where(bound > -np.inf, bound - 1e-9 * self.hashes.norm**2, np.finfo(float).min)
        least = np.array([i[0] for i in m.column("ids").to_pylist()], np.int64)
        rank = np.argsort(np.argsort(least))
        most = self.most
        qs, ms = [], []
        for a in range(0, len(x), 128):
            b = min(len(x), a + 128)
            seen = np.zeros((b - a, len(code)), bool)
            lo, hi = np.searchsorted(who, (a, b))
            seen[who[lo:hi] - a, at[lo:hi]] = True
            s = np.where(seen[:, place], x[a:b] @ y.T, -np.inf)
            for i in range(b - a):
                c = np.flatnonzero(s[i] >= bound[a + i])
                if len(c) > most:
                    edge = np.partition(s[i][c], len(c) - most)[len(c) - most]
                    c = c[s[i][c] >= edge]
                c = c[np.lexsort((rank[c], -s[i][c]))][:most]
                qs.append(np.full(len(c), a + i))
                ms.append(c)
        qs, ms = np.concatenate(qs), np.concatenate(ms)
        exact = np.einsum("ij,ij->i", x[qs], y[ms])
        take = lambda t, c, i: t.column(c).combine_chunks().take(pa.array(i))
        return pa.table({"q1": take(q, "h1", qs), "q2": take(q, "h2", qs), "m1": take(m, "h1", ms), "m2": take(m, "h2", ms), "score": pa.array(exact), "ids": take(m, "ids", ms).cast(pa.list_(pa.int64()))})
