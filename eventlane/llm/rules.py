"""Quality rules as a bitmask ledger, with DataFrame functions only.

``ledger`` evaluates every rule once for each document and keeps the
measurements and one failure bit a rule.  Policies are versioned sets of rules:
a document passes if none of the policy's bits is set, so policies can be
applied, compared and ablated later without touching a text again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlane.llm.graph import cut
from eventlane.llm.text import GAP

WINDOW = 5

#: Failure bit of each rule, as a condition on the measurements.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "upper_case": "100 * n_upper > 40 * word_chars",
}

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def repeat_words(parts: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the array ``parts``."""

    def covered(at: Column) -> Column:
        total = F.aggregate(
            F.sequence(F.lit(1), F.size(at) - 1),
            F.lit(width).cast("long"),
            lambda a, i: a + F.least(F.lit(width), F.get(at, i) - F.get(at, i - 1)),
        )
        return F.when(F.size(at) > 1, total).otherwise(F.lit(0).cast("long"))

    def places(s: Column) -> Column:
        twice = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: let(F.get(s, i)["w"], lambda w: F.coalesce(F.get(s, i - 1)["w"].eqNullSafe(w), F.lit(False)) | F.get(s, i + 1)["w"].eqNullSafe(w)),
        )
        return F.sort_array(F.transform(twice, lambda i: F.get(s, i)["i"]))

    def repeated(w: Column) -> Column:
        marked = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(let(marked, places), covered))

    windows = F.transform(F.sequence(F.lit(1), F.size(parts) - (width - 1)), lambda i: F.array_join(F.slice(parts, i, width), " "))
    return F.when(F.size(parts) >= width, let(windows, repeated)).otherwise(F.lit(0).cast("long"))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and failure bits of each document.

    One row for each input row: ``doc_id``, ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words``,
    ``n_upper`` and ``fail_bits``.  A null text has no words, so it fails the
    first rule.  Columns other than ``doc_id`` and ``text`` are ignored.
    """
    d = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    long = lambda c: c.cast("long")

    def of_words(w: Column) -> Column:
        return F.struct(long(F.size(w)).alias("n_words"), long(F.length(F.array_join(w, ""))).alias("word_chars"), repeat_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = d.select(
        "doc_id",
        let(words(F.col("text")), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        long(F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
        long(F.length("text") - F.length(F.regexp_replace("text", "[A-ZÀ-ÖØ-Þ]+", ""))).alias("n_upper"),
    ).select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words", "n_upper")
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())])
    return m.withColumn("fail_bits", bits.cast("long"))


def apply_policy(ledger_: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` (no rule of the policy, nor of ``base``, failed) and the ``policy`` that decided."""
    base, bits = mask(POLICIES["base"]), mask(POLICIES[policy])
    failed = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m)) != 0
    return ledger_.withColumns({"base_failed": failed(base), "kept": ~failed(base | bits), "policy": F.lit(policy)})


def stored(ledger_: DataFrame) -> DataFrame:
    """The ledger, written once to the shared checkpoint folder: policies and ablations read bits, no text is evaluated again."""
    return cut(ledger_)


def ablation(ledger_: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that it alone rejects (one row a rule).

    Reads ``fail_bits`` alone: at most one row for each set of bits is left
    before rules are told apart.
    """
    m = mask(POLICIES[policy])
    names = list(RULES)
    sets = ledger_.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rows = sets.select("n", "bits", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(n(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"), n(F.col("bits") == F.col("r.bit")).alias("n_only"))


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.  The ledger is computed row by row: no join."""
    row = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("own_row"))
    return _ledger_with(row, "own_row", policy).where("kept").select("own_row.*")


def _ledger_with(row: DataFrame, extra: str, policy: str) -> DataFrame:
    inner = row.select(F.struct("doc_id", extra).alias("doc_id"), "text")
    return apply_policy(ledger(inner), policy).select(F.col(f"doc_id.{extra}").alias(extra), "kept")
