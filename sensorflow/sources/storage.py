"""Where intermediate tables live, and the prepared-feature table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sensorflow.schema import SUBJECT


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path that every executor can reach.

    It lies in the folder named by ``spark.checkpoint.dir`` or, where that is
    unset, given to ``SparkContext.setCheckpointDir``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_if_any(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table of this schema; empty where nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def stage(spark: SparkSession, folder: str, name: str, write: Callable[[str], DataFrame], read: Callable[[str], DataFrame]) -> DataFrame:
    """A table of a job that can be continued: ``name`` in ``folder``, read back if it was written whole, else written anew.

    It is whole if the marker that is committed after it is there and has its number of rows. What an interrupted
    write left is replaced; so ``write`` must overwrite.
    """
    path, marker = f"{folder}/{name}", f"{folder}/committed/{name}"
    marked = [row.rows for row in read_if_any(spark, marker, "rows long").collect()]
    if marked:
        try:
            known = read(path)
            if marked == [known.count()]:
                return known
        except AnalysisException:
            pass  # the table is gone: written anew
    table = write(path)
    spark.createDataFrame([(table.count(),)], "rows long").coalesce(1).write.mode("overwrite").parquet(marker)
    return table


LONGEST_METHOD = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compilable(spark: SparkSession) -> Iterator[None]:
    """Let Spark split generated code that the JVM would not compile, unless the session says otherwise.

    HotSpot interprets methods of more than 8,000 bytes, as those of some 50 sensor columns; Spark's documentation of the setting names that value.
    """
    if spark.conf.get(LONGEST_METHOD, "65535") != "65535":
        yield
        return
    spark.conf.set(LONGEST_METHOD, "8000")
    try:
        yield
    finally:
        spark.conf.unset(LONGEST_METHOD)


def write_by_subject(df: DataFrame, path: str, subject: str = SUBJECT, mode: str = "error") -> DataFrame:
    """Write a Parquet table with one directory per subject and read it back.

    No repartition first: tasks write what they hold, so a subject with most of
    the rows is written by many tasks.
    """
    with compilable(df.sparkSession):
        df.write.mode(mode).partitionBy(subject).parquet(path)
    return read_by_subject(df.sparkSession, path, df.schema)


def read_by_subject(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a subject-partitioned table; a filter on subject prunes directories.

    Subjects are text as in the directory names: ``001`` stays ``001``.
    """
    if schema is None:
        found = spark.read.parquet(path).schema
        schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == SUBJECT else f.dataType) for f in found])
    return spark.read.schema(schema).parquet(path)
