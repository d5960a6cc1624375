"""A training-data pipeline of the operators in ``sensorflow.llm``.

``STAGES`` are applied to ``documents`` in turn; each stage's result is written as Parquet and read again as the
next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.llm import mixing, near_dedup, packing, quality, secret_scan
from sensorflow.llm.queries import END_ID, trusted_ids
from sensorflow.llm.staging import source, stored, work_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and the likelihood ratio against documents labelled good."""
    return quality.keep(docs, trusted_ids(spark, sf_dir))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on shingles of five words."""
    return near_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text where it changed."""
    scanned = secret_scan.scan(docs, redact=True)
    length = F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return scanned.withColumn("n_chars", length).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and in the order the curriculum takes them; one not taken goes, one taken again repeats."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=END_ID)


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", keep_one_of_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Hashed n-grams, MinHash, compression and bin packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the last stage's result, read from where it is written."""
    docs, folder = source(spark, sf_dir, "documents"), work_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{number}-{name}")
    return docs
