"""A training corpus from ``documents``: five stages, each works on all rows that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlane.llm import bpe, mixing, radix, rules, simhash
from eventlane.llm.graph import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: XXH64 fingerprints, components and BPE are beyond SQL; tests compare fingerprints, links, repeats and BPE with brute force, not the stages as wholes.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents whose five-word shingles are alike by 0.8 or more the one with the smallest id stays."""
    return simhash.keep_one(docs, simhash.similar)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that an earlier document has go (with what is left of a cut character); texts left empty go."""
    found = radix.repeated_windows(docs, carry=("lang", "source", "n_chars"))
    # bytes of a character that was cut become U+FFFD when the rest is made a valid string, and go with it; whole texts keep theirs
    left = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\uFFFD", "")
    text = F.when(F.size("spans") == 0, F.col("kept").cast("string")).otherwise(left)
    kind = dict(docs.dtypes)["n_chars"]
    return found.withColumn("text", text).where("text <> ''").select("doc_id", "text", "lang", "source", F.length("text").cast(kind).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeats), ("mix_to_target", mix), ("bpe_encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    import uuid

    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
