"""Tables written between the jobs of one operator, in a folder all executors share."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/checkpoints"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a single-process local session without that setting uses a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = LOCAL_FOLDER
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, **options) -> DataFrame:
    """Write a table and read it back, so that later jobs start from files."""
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def worker_memo() -> dict:
    """A dictionary that lasts as long as this Python process: a reused worker runs many tasks.

    Tasks that need memory for other work clear it.
    """
    return vars(sys).setdefault("_corpus_worker_memo", {})
