"""Quality score: a generalised additive model with pairwise interactions.

Features are cut into bins; shallow trees on one feature's histogram at a time,
boosted in cycles with a small step, add up to one lookup table a feature.  Then
the pairs of features with the largest gain on the residual get tables of their
own in the same way.  A score is a sum of table entries, so scoring a batch is
one indexed addition a table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlane.llm.graph import cut
from eventlane.llm.text import id_text, texts

FEATURES = ("log_words", "word_length", "symbols", "bars", "upper", "digits", "marks", "shouts", "distinct", "repeats", "pairs", "lines", "same_lines", "longest_line", "wide")
#: At most so many labelled rows (those whose ids hash lowest) are gathered for the fit.
MOST_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, CYCLES, RATE = 32, 8, 6, 120, 0.15

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&<>"
_MARK = b".,;:?"
_ASCII = bytes(range(128))


def features(t: bytes) -> list[float]:
    """Measurements of a whole text; an empty text gives zeros."""
    w = t.split()
    n = len(w)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(t)
    count = lambda chars: size - len(t.translate(None, chars))
    lines = [x for x in t.split(b"\n") if x]
    letters = sum(map(len, w))
    follow = list(zip(w, w[1:]))
    return [
        float(np.log1p(n)), letters / n, count(_SYMBOL) / n, t.count(b"|") / n, count(_UPPER) / letters, count(_DIGIT) / letters, count(_MARK) / n, t.count(b"!") / n,
        len(set(w)) / n, sum(a == b for a, b in follow) / n, len(set(follow)) / n, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(max(map(len, lines), default=0))), (size - count(_ASCII)) / size,
    ]


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x`` (the features) of each row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in texts(b.column(1))], pa.list_(pa.float64()))], ["doc_id", "x"])

    d = id_text(docs)
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, x array<double>")


class Model:
    """Bin edges, tables of single features and of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins=BINS, pair_bins=PAIR_BINS, pairs=PAIRS, cycles=CYCLES, rate=RATE):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pair_edges = [np.unique(np.quantile(c, np.linspace(0, 1, pair_bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        self.base = 0.0
        if not len(y):
            return
        rate_1 = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(rate_1 / (1 - rate_1)))
        if y.min() == y.max():
            return
        at = self._bins(x, self.edges)
        score = np.full(len(y), self.base)
        for _ in range(cycles):
            for k, table in enumerate(self.tables):
                step = rate * self._tree(at[k], y, score, len(table))
                table += step
                score += step[at[k]]
        two = self._bins(x, self.pair_edges)
        gain = {}
        for i, j in combinations(range(x.shape[1]), 2):
            g, h = self._sums(self._cell(two, i, j), y, score, len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1)
            gain[i, j] = float((g**2 / (h + 1.0)).sum())
        for i, j in sorted(gain, key=gain.get, reverse=True)[:pairs]:
            self.pairs[i, j] = np.zeros((len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1))
        for _ in range(cycles // 4):
            for (i, j), table in self.pairs.items():
                cell = self._cell(two, i, j)
                step = rate * self._tree2(*self._sums(cell, y, score, *table.shape))
                table += step
                score += step.ravel()[cell]

    @staticmethod
    def _bins(x, edges):
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]

    def _cell(self, at, i, j):
        return at[i] * (len(self.pair_edges[j]) + 1) + at[j]

    @staticmethod
    def _sums(cell, y, score, *shape):
        p = 1 / (1 + np.exp(-score))
        n = int(np.prod(shape))
        return np.bincount(cell, y - p, n).reshape(shape), np.bincount(cell, p * (1 - p), n).reshape(shape)

    def _tree(self, at, y, score, n):
        """Leaf values by bin of the best tree with at most three leaves."""
        g, h = self._sums(at, y, score, n)
        cuts = [0, n]
        for _ in range(2):
            best = None
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a < 2:
                    continue
                gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gt, ht = g[a:b].sum(), h[a:b].sum()
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                k = int(np.argmax(gain))
                if best is None or gain[k] > best[0]:
                    best = (gain[k], a + k + 1)
            if best is None or best[0] <= 0:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.zeros(n)
        for a, b in zip(cuts[:-1], cuts[1:]):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
        return out

    @staticmethod
    def _tree2(g, h):
        """Leaf values by cell of the best split of one axis crossed with one of the other."""
        best, out = -1.0, np.zeros_like(g)
        gi, hi = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        for a in range(1, g.shape[0]):
            for b in range(1, g.shape[1]):
                parts = []
                for x in (gi, hi):
                    tl, top, left, every = x[a - 1, b - 1], x[a - 1, -1], x[-1, b - 1], x[-1, -1]
                    parts.append(np.array([tl, top - tl, left - tl, every - top - left + tl]))
                gain = float((parts[0] ** 2 / (parts[1] + 1)).sum())
                if gain > best:
                    v = parts[0] / (parts[1] + 1.0)
                    best = gain
                    out = np.zeros_like(g)
                    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = v
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for at, table in zip(self._bins(x, self.edges), self.tables, strict=True):
            total += table[at]
        if self.pairs:
            two = self._bins(x, self.pair_edges)
            for (i, j), table in self.pairs.items():
                total += table[two[i], two[j]]
        return 1 / (1 + np.exp(-total))


def fit(measured: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """A model from rows of ``labels`` (``doc_id``, ``label`` 0 or 1) whose features are in ``measured``.

    Null labels don't count; of several labels of one document the largest
    counts.  Without rows, or with one class only, the score is constant.  Of
    very many labels only those whose hash can be among the lowest are joined
    and sent to the driver, half as many again as are used.
    """
    one = labels.where("label is not null and doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("label").alias("label")).withColumn("h", F.md5(F.col("labelled").cast("string")))
    part = 1.5 * most_rows / max(1, one.count())
    if part < 1:
        one = one.where(F.col("h") < f"{int(part * 2**32):08x}")
    rows = measured.join(one, F.col("doc_id") == F.col("labelled")).select("x", "label", "h").orderBy("h").limit(most_rows).collect()
    return Model(np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id`` and ``score`` (probability of label 1) for each row of ``docs``; null texts count as empty."""
    measured = cut(measure(docs))
    model = fit(measured, labels, most_rows)

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return measured.mapInArrow(run, f"doc_id {dict(measured.dtypes)['doc_id']}, score double")
