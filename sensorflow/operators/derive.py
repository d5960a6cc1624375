"""Derived columns and feature selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorflow.operators.lookup import look_up
from sensorflow.schema import ACTIVITY, ACTIVITY_NAMES, HEART_RATE, LABEL, SUBJECT, TEMPERATURE_COLUMNS, TIME
from sensorflow.sources.dimensions import literal_map

RESIDUAL = "heart_rate_minus_rest"
MEAN_TEMPERATURE = "avg_temperature"
NOT_FEATURES = (TIME, ACTIVITY, LABEL)


def with_baseline(
    df: DataFrame, baseline: Mapping | DataFrame, output: str, subject: str = SUBJECT, column: str | None = None
) -> DataFrame:
    """Add the subject's baseline, null for a subject without one.

    A mapping becomes a literal. Of a table, ``column`` holds the baseline; it may be left out where the
    table has one column besides the subject. Two rows for one subject are an error when they are read. The table is
    counted and joined as :func:`~sensorflow.operators.lookup.look_up` says, so a subject with most of the rows is in no single task.
    """
    if not isinstance(baseline, DataFrame):
        return df.withColumn(output, literal_map(baseline)[F.col(subject)])
    if column is None:
        others = [name for name in baseline.columns if name != subject]
        if len(others) != 1:
            raise ValueError(f"name the baseline column, one of {others}")
        column = others[0]
    twice = F.raise_error(F.concat(F.lit("two baselines for subject "), F.col(subject).cast("string")))
    levels = baseline.groupBy(subject).agg(F.count("*").alias("_rows"), F.first(column).alias("_level"))
    single = levels.select(subject, F.when(F.col("_rows") > 1, twice).otherwise(F.col("_level")).alias(output))
    return look_up(df, single, [subject])


def subtract_baseline(
    df: DataFrame,
    baseline: Mapping | DataFrame,
    value: str = HEART_RATE,
    output: str = RESIDUAL,
    subject: str = SUBJECT,
    strict: bool = False,
    column: str | None = None,
) -> DataFrame:
    """Value minus the subject's baseline, see :func:`with_baseline`.

    ``strict`` makes a subject without a baseline an error when its rows are
    read; else its residuals are null.
    """
    leveled = with_baseline(df, baseline, "_level", subject, column)
    unknown = F.raise_error(F.concat(F.lit("no baseline for subject "), F.coalesce(F.col(subject).cast("string"), F.lit("null"))))
    level = F.coalesce(F.col("_level"), unknown.cast("double")) if strict else F.col("_level")
    return leveled.withColumn(output, F.col(value) - level).drop("_level")


def name_labels(
    df: DataFrame,
    names: Mapping[int, str] = ACTIVITY_NAMES,
    activity: str = ACTIVITY,
    output: str = LABEL,
    trim: bool = True,
) -> DataFrame:
    """Activity name of the code; null for an unknown code."""
    texts = {code: name.strip() if trim else name for code, name in names.items()}
    return df.withColumn(output, literal_map(texts)[F.col(activity)])


def row_mean(columns: Sequence[str]) -> Column:
    return reduce(Column.__add__, map(F.col, columns)) / len(columns)


def mean_temperature(df: DataFrame, columns: Sequence[str] = TEMPERATURE_COLUMNS) -> DataFrame:
    return df.withColumn(MEAN_TEMPERATURE, row_mean(columns))


def feature_columns(df: DataFrame, keys: Sequence[str] = (SUBJECT,)) -> list[str]:
    """All columns but time, activity, label and the row keys, in schema order."""
    left_out = {*NOT_FEATURES, *keys}
    return [name for name in df.columns if name not in left_out]
