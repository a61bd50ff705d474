"""Toxicity score: a convolutional classifier over hashed words, trained in numpy.

Words are hashed to embeddings; filters one to three words wide slide over the
whole text and each keeps its largest response.  Because only the places of the
maxima carry gradients, a training step touches a few rows of the embeddings.
The first embedding component starts as the word's log-odds in the training
rows, the others at random.  For scoring, filters are folded into tables by
word, so a text costs one table look-up for each word and filter row.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlane.llm.graph import cut
from eventlane.llm.text import id_text, texts

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
#: At most so many labelled rows of each class (those whose ids hash lowest) are gathered for the fit.
MOST_ROWS = 3_000
#: And of these at most so many words of each class, in the order of their hashes (the first row whatever its length).
MOST_WORDS = 2_000_000
EPOCHS = 6
_EDGE = b".,;:!?#*$%&|<>()[]\"'"


def word_ids(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed words, without marks around them and in lower case (A-Z); at least three, padded with 0."""
    ids = [crc32(w.strip(_EDGE)) % (buckets - 1) + 1 for w in text.lower().split()]
    return np.array(ids + [0] * (max(WIDTHS) - len(ids)), np.int64)


class Model:
    def __init__(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.05, (BUCKETS, DIM))
        self.emb[0] = 0
        self.filt = [rng.normal(0, 0.2, (k * DIM, FILTERS)) for k in WIDTHS]
        self.bias = [np.zeros(FILTERS) for _ in WIDTHS]
        self.out = rng.normal(0, 0.2, len(WIDTHS) * FILTERS)
        self.base = 0.0
        n1, n0 = float(y.sum()), float(len(y) - y.sum())
        if not n1 or not n0:
            self.base = 0.0 if not len(y) else (4.0 if n1 else -4.0)
            self.out[:] = 0
            return self._fold()
        seen = np.zeros((2, BUCKETS))
        for ids, label in zip(rows, y, strict=True):
            seen[int(label), np.unique(ids)] += 1
        odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
        self.emb[:, 0] = np.where(seen.sum(0) > 2, np.clip(odds, -3, 3) / 3, 0)
        self.emb[0] = 0
        for f in self.filt:
            f[::DIM, : FILTERS // 2] = np.abs(f[::DIM, : FILTERS // 2]) + 0.5
        self.base = float(np.log(n1 / n0))
        sums = {"emb": np.full(self.emb.shape, 1e-2), "out": np.full(self.out.shape, 1e-2), "base": 1e-2}
        sums_f, sums_b = [np.full(f.shape, 1e-2) for f in self.filt], [np.full(FILTERS, 1e-2) for _ in WIDTHS]
        rate = 0.05
        for _ in range(epochs):
            for r in rng.permutation(len(rows)):
                ids = rows[r]
                x = self.emb[ids]
                best, peak, wins = [], [], []
                for k, f, b in zip(WIDTHS, self.filt, self.bias, strict=True):
                    w = np.concatenate([x[j : len(x) - k + 1 + j] for j in range(k)], axis=1)
                    z = w @ f + b
                    at = z.argmax(0)
                    best.append(z[at, np.arange(FILTERS)])
                    peak.append(at)
                    wins.append(w[at])
                m = np.concatenate(best)
                relu = np.maximum(m, 0)
                p = 1 / (1 + np.exp(-(relu @ self.out + self.base)))
                d = p - y[r]
                dm = d * self.out * (m > 0)
                g = d * relu
                sums["out"] += g * g
                self.out -= rate * g / np.sqrt(sums["out"])
                sums["base"] += d * d
                self.base -= rate * d / np.sqrt(sums["base"])
                for q, k in enumerate(WIDTHS):
                    dq = dm[q * FILTERS : (q + 1) * FILTERS]
                    gf = wins[q].T * dq
                    back = (self.filt[q] * dq).T.reshape(FILTERS, k, DIM)
                    sums_f[q] += gf * gf
                    self.filt[q] -= rate * gf / np.sqrt(sums_f[q])
                    sums_b[q] += dq * dq
                    self.bias[q] -= rate * dq / np.sqrt(sums_b[q])
                    to = ids[peak[q][:, None] + np.arange(k)]
                    keep = (to != 0) & (dq != 0)[:, None]
                    if keep.any():
                        t, gb = to[keep], back[keep]
                        sums["emb"][t] += gb * gb
                        self.emb[t] -= rate * gb / np.sqrt(sums["emb"][t])
        self._fold()

    def _fold(self):
        self.tables = [[(self.emb @ f[j * DIM : (j + 1) * DIM]).astype(np.float32) for j in range(k)] for k, f in zip(WIDTHS, self.filt, strict=True)]
        self.bias = [b.astype(np.float32) for b in self.bias]
        del self.emb, self.filt

    def score(self, ids: np.ndarray) -> float:
        best = []
        for k, rows, b in zip(WIDTHS, self.tables, self.bias, strict=True):
            n, top = len(ids) - k + 1, np.full(FILTERS, -np.inf, np.float32)
            for at in range(0, n, 1 << 14):
                m = min(1 << 14, n - at)
                z = rows[0][ids[at : at + m]]
                for j in range(1, k):
                    z = z + rows[j][ids[at + j : at + j + m]]
                top = np.maximum(top, z.max(0))
            best.append(np.maximum(top + b, 0))
        return float(1 / (1 + np.exp(-(np.concatenate(best).astype(float) @ self.out + self.base))))


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS):
    """Hashed words and label of the rows to fit on, a bounded number whatever the size of ``labels``; the share of label 1.

    Null labels don't count; of several labels of one document the largest counts.
    """
    one = labelled(labels).withColumn("h", F.md5(F.col("doc_id").cast("string")))
    picked = None
    for k in (0, 1):
        part = one.where(F.col("label") == k).orderBy("h").limit(most_rows)
        picked = part if picked is None else picked.union(part)
    share = one.agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.0
    kind = dict(docs.dtypes)["doc_id"]
    picked = docs.sparkSession.createDataFrame(picked.select("doc_id", "label", "h").collect(), f"doc_id {dict(labels.dtypes)['doc_id']}, label int, h string")
    d = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_ids(t).astype(np.int32).tobytes() for t in texts(b.column(0))], pa.binary()), b.column(1), b.column(2), b.column(3)], ["ids", "label", "doc_id", "h"])

    rows = d.join(F.broadcast(picked.withColumnRenamed("doc_id", "picked")), F.col("doc_id") == F.col("picked")).select("text", "label", "doc_id", "h").mapInArrow(run, f"ids binary, label int, doc_id {kind}, h string")
    # rows are picked already, so a window by label holds a bounded number of them; what goes to the driver is bounded in words too
    line = Window.partitionBy("label").orderBy("h", "ids").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.octet_length("ids") / 4).over(line), F.lit(0.0)))
    rows = rows.where((F.col("before") == 0) | (F.col("before") + F.octet_length("ids") / 4 <= MOST_WORDS)).select("doc_id", "ids", "label").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["ids"]))
    return [np.frombuffer(r["ids"], np.int32).astype(np.int64) for r in rows], np.array([r["label"] for r in rows], float), share


def labelled(labels: DataFrame) -> DataFrame:
    """One label a document: null labels don't count, of several the largest counts."""
    return labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))


def thresholds(scored: DataFrame, labels: DataFrame) -> dict[str, float]:
    """For each language the threshold with the best F1 on all labelled rows (0.5 where there are under ten positives).

    Only counts by language and step of the grid reach the driver.
    """
    grid = np.linspace(0.05, 0.95, 19)
    one = labelled(labels).select(F.col("doc_id").alias("labelled_id"), "label")
    step = sum(((F.col("score") >= float(t)).cast("int") for t in grid), F.lit(0))
    rows = scored.join(one, F.col("doc_id") == F.col("labelled_id")).groupBy("lang", step.alias("step")).agg(F.count_if(F.col("label") == 1).alias("n1"), F.count(F.lit(1)).alias("n")).collect()
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r["lang"], np.zeros((2, len(grid) + 1), np.int64))[:, r["step"]] += (r["n1"], r["n"])
    out = {}
    for g, c in sorted(counts.items()):
        hit, flagged = c[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
        if c[0].sum() < 10:
            out[g] = 0.5
            continue
        f1 = 2 * hit / np.maximum(1, c[0].sum() + flagged)
        close = np.flatnonzero(f1 >= f1.max() - 1e-9)
        out[g] = float(grid[close[np.argmin(np.abs(grid[close] - 0.5))]])
    return out


def score(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id``, ``score`` (probability of label 1) and ``flagged`` (by the language's threshold) for each row.

    ``labels`` has ``doc_id`` and ``label`` (0 or 1).  Null and empty texts are
    scored as texts without words.  The model is fitted on a sample, the
    thresholds are chosen on all labelled rows.  The language decides ``flagged`` only,
    never the score.
    """
    rows, y, share = sample(docs, labels, most_rows)
    model = Model(rows, y)
    if 0 < share < 1 and 0 < y.mean() < 1:  # both classes were gathered up to the same bound: back to their share among all labels
        model.base += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of tables of a fixed size

    def run(batches):
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(word_ids(t)) for t in texts(b.column(1))], pa.float64()), b.column(2)], ["doc_id", "score", "lang"])

    lang = docs["lang"] if "lang" in docs.columns else F.lit("")
    d = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
    out = cut(d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, score double, lang string"))  # scored once, for the thresholds and the result
    limit = thresholds(out, labels)
    at = F.coalesce(F.create_map(*[F.lit(x) for kv in limit.items() for x in kv])[F.col("lang")], F.lit(0.5)) if limit else F.lit(0.5)
    return out.select("doc_id", "score", (F.col("score") >= at).cast("int").alias("flagged"))
