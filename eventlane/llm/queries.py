"""The registered queries of the subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlane.llm import ann, bpe, gam, mixing, passages, radix, rules, simhash, toxicity, wordpiece
from eventlane.llm.oracles import ORACLES as ORACLES
from eventlane.llm.text import crc_bucket, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _labels(spark: SparkSession, sf_dir: str, label: str, n: int, held_out: int) -> DataFrame:
    """The labels to learn from: without the documents held out."""
    d = table(spark, sf_dir, "labels")
    return d.where(crc_bucket(d["doc_id"], n) != held_out).select(d["doc_id"], d[label].cast("int").alias("label"))


def op1_passages_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.classes(passages.near_duplicate_passages(table(spark, sf_dir, "documents")))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", covered.alias("dup_words"), F.size("spans").cast("long").alias("n_passages"), "n_links", "class_id")


def op2_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), _labels(spark, sf_dir, "toxic", 5, 0))
    return found.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")


def op3_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_bpe_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op5_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_mix_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.apply_policy(rules.stored(rules.ledger(table(spark, sf_dir, "documents"))))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "policy", "fail_bits")


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablation(rules.stored(rules.ledger(table(spark, sf_dir, "documents"))))


def op9_gam_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gam.score(table(spark, sf_dir, "documents"), _labels(spark, sf_dir, "quality", 4, 2))
    return found.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = radix.repeated_windows(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_passages_compact_windows, op2_toxicity_cnn, op3_wordpiece_counts, op4_bpe_rank_queue, op5_multiprobe_lsh, op6_simhash_golay, op7_mix_sainte_lague, op8_rule_ledger, rule_ablation, op9_gam_pairs, op10_suffix_radix)}
