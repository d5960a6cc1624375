"""Session settings for local runs; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", memory: str = "12g", folder: str | None = None) -> SparkSession:
    """A session on this machine; ``folder`` takes the tables that jobs write for later jobs."""
    partitions = "8" if cores == "*" else str(cores)
    builder = SparkSession.builder if folder is None else SparkSession.builder.config("spark.checkpoint.dir", folder)
    spark = (
        builder.master(f"local[{cores}]")
        .appName("sensorflow")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
