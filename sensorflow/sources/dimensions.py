"""Small fixed dimensions: resting heart rate and activity names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.schema import ACTIVITY_NAMES, RESTING_HEART_RATE, SUBJECT


def resting_heart_rate(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RESTING_HEART_RATE.items()), f"{SUBJECT} string, resting_hr int")


def activity_names(spark: SparkSession, trim: bool = True) -> DataFrame:
    rows = [(code, name.strip() if trim else name) for code, name in ACTIVITY_NAMES.items()]
    return spark.createDataFrame(rows, "activity_id int, label string")


def literal_map(entries: Mapping):
    """A map literal for lookups without a join; for a handful of fixed entries."""
    return F.create_map(*[F.lit(part) for entry in entries.items() for part in entry])


def check_subjects(df: DataFrame, baseline: Mapping | DataFrame, subject: str = SUBJECT) -> None:
    """Raise when a subject has no baseline, or a null one, or a baseline table has two rows for one."""
    subjects = df.select(subject).distinct()
    if isinstance(baseline, DataFrame):
        doubled = baseline.groupBy(subject).agg(F.count("*").alias("_rows")).filter("_rows > 1")
        twice = [row[0] for row in doubled.limit(20).collect()]
        if twice:
            raise ValueError(f"two baselines for subjects such as {twice}")
        unknown = subjects.join(baseline.dropna().select(subject), subject, "left_anti")
    else:
        known = F.coalesce(F.col(subject).isin(*baseline), F.lit(False))
        unknown = subjects.filter(~known)
    names = [row[0] for row in unknown.limit(20).collect()]
    if names:
        raise KeyError(f"no baseline for subjects such as {names}")
