"""Text source: space-delimited sample files, one file or directory per subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorflow.schema import BAD_LINE, SENSOR_SCHEMA, SOURCE_FILE, SUBJECT
from sensorflow.sources.storage import read_if_any, write_by_subject

DELIMITER = " "
FILE_OFFSET = "file_offset"
LINE_ORDER = "line_order"
SUBJECT_FROM_FILE = r"([^/]+)\.dat$"
INGEST = "ingest"
LISTED = "path string, length long, modified timestamp"
MANIFEST = f"{LISTED}, {INGEST} int"


def read_subject_files(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = SENSOR_SCHEMA,
    subject_pattern: str = SUBJECT_FROM_FILE,
    file_glob: str = "*.dat",
    rescue: bool = False,
) -> DataFrame:
    """All subjects' files as one table with a ``subject`` column.

    The subject is the first group of ``subject_pattern`` in the file path, with
    percent signs decoded; a path that does not match is an error when it is read.
    Files are split between tasks, so one large file is no bottleneck.
    ``file_offset`` is where the split of a row starts in its file; see
    :func:`with_line_order`.

    A line with too many or too few fields, or with a field of another type, keeps what could be parsed, the rest is null. With ``rescue`` the whole
    line is in ``bad_line`` besides, null for good lines, and the file in ``source_file``. Store the rows before selecting columns of them: the scan checks only fields it reads.
    """
    wanted = T.StructType([*schema, T.StructField(BAD_LINE, T.StringType())]) if rescue else schema
    rows = (
        spark.read.schema(wanted)
        .option("columnNameOfCorruptRecord", BAD_LINE)
        .option("header", False)
        .option("sep", DELIMITER)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_glob)
        .csv(path)
    )
    named = F.regexp_extract("_metadata.file_path", subject_pattern, 1)
    subject = F.url_decode(F.replace(named, F.lit("+"), F.lit("%2B")))
    nameless = F.raise_error(F.concat(F.lit("no subject in the file path "), F.col("_metadata.file_path")))
    return rows.select(
        F.when(named == "", nameless).otherwise(subject).alias(SUBJECT),
        F.col("_metadata.file_block_start").alias(FILE_OFFSET),
        *([F.col("_metadata.file_path").alias(SOURCE_FILE)] if rescue else []),
        "*",
    )


def with_line_order(df: DataFrame) -> DataFrame:
    """Add ``line_order``: with ``file_offset`` it orders a subject's rows as in the file.

    The id grows with the line inside one split, and ``file_offset`` orders the
    splits. Call it after row filters (they would not pass below it) and store
    the result before using the id as a key: its value depends on the splits.
    """
    return df.withColumn(LINE_ORDER, F.monotonically_increasing_id())


def ingest_subject_files(spark: SparkSession, path: str | list[str], target: str, mode: str = "error", **options) -> DataFrame:
    """Parse the text once into a Parquet table by subject, rows numbered in file order."""
    return write_by_subject(with_line_order(read_subject_files(spark, path, **options)), target, mode=mode)


def list_files(spark: SparkSession, path: str | list[str], file_glob: str = "*.dat") -> DataFrame:
    """path, length and modified of each file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", file_glob).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    """The files that ``target`` holds, as last ingested: path, length, modified and number of the ingest."""
    entries = read_if_any(spark, f"{target}/manifest", MANIFEST)
    last = F.max_by(F.struct("length", "modified", INGEST), INGEST)
    return entries.groupBy("path").agg(last.alias("e")).select("path", "e.*")


def ingest_changed_files(spark: SparkSession, path: str | list[str], target: str, file_glob: str = "*.dat", **options) -> DataFrame:
    """Parse the files that ``target`` does not hold yet, or holds with another length or time; returns :func:`read_ingested`.

    Rows of an ingest are written first, under its number, then the entries of its files: an ingest that stopped before is done again under
    the same number and replaces what it left. A file that is gone keeps its rows.
    """
    known = read_manifest(spark, target)
    new = list_files(spark, path, file_glob).join(known, ["path", "length", "modified"], "left_anti")
    number = (known.agg(F.max(INGEST)).first()[0] or 0) + 1
    entries = new.collect()  # the driver holds the list of the files it scans anyway
    if entries:
        rows = read_subject_files(spark, [row.path for row in entries], file_glob="*", **{"rescue": True, **options})
        with_line_order(rows).write.mode("overwrite").parquet(f"{target}/rows/{INGEST}={number}")
        spark.createDataFrame(entries, new.schema).coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/{INGEST}={number}")
    return read_ingested(spark, target)


def read_ingested(spark: SparkSession, target: str, schema: T.StructType = SENSOR_SCHEMA) -> DataFrame:
    """Rows of the files in the manifest, each file as it was last ingested, with ``source_file`` and ``ingest``."""
    text, number = T.StringType(), T.LongType()
    columns = [T.StructField(SUBJECT, text), T.StructField(FILE_OFFSET, number), T.StructField(SOURCE_FILE, text), *schema]
    columns += [T.StructField(BAD_LINE, text), T.StructField(LINE_ORDER, number), T.StructField(INGEST, T.IntegerType())]
    rows = read_if_any(spark, f"{target}/rows", T.StructType(columns))
    current = read_manifest(spark, target).select(F.col("path").alias(SOURCE_FILE), INGEST)
    return rows.join(current, [SOURCE_FILE, INGEST], "left_semi").select(*[field.name for field in columns])


def parse_lines(lines: DataFrame, column: str = "value", schema: T.StructType = SENSOR_SCHEMA) -> DataFrame:
    """Parse a string column of sample lines; other columns are kept in front."""
    parsed = F.from_csv(column, schema.toDDL(), {"sep": DELIMITER})
    others = [name for name in lines.columns if name != column]
    return lines.select(*others, parsed.alias("_sample")).select(*others, "_sample.*")
