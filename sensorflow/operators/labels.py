"""Numbering of labels as a plain aggregate, and the class distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorflow.operators.lookup import look_up
from sensorflow.schema import INDEXED_LABEL, LABEL, SUBJECT


def class_distribution(df: DataFrame, label: str = LABEL, by: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """Rows per label, rows without a label included."""
    return df.groupBy(*by, label).agg(F.count("*").alias("count"))


def label_index(df: DataFrame, label: str = LABEL, by: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """Index of each label: most frequent 0, equal counts in alphabetical order.

    The ranking runs over one row per label, not over the samples.
    """
    return index_of_counts(class_distribution(df.filter(F.col(label).isNotNull()), label, by), label, by)


def index_of_counts(counts: DataFrame, label: str = LABEL, by: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """The same from a class distribution without null labels."""
    ranked = Window.partitionBy(*by).orderBy(F.desc("count"), label)
    return counts.withColumn(INDEXED_LABEL, (F.row_number().over(ranked) - 1).cast("double"))


def with_label_index(df: DataFrame, index: DataFrame, label: str = LABEL, output: str = INDEXED_LABEL,
                     by: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """Look up the index of a label column; null for a label without one.

    The index has one row per subject and label. It is counted and joined as
    :func:`~sensorflow.operators.lookup.look_up` says: rows are not shuffled by their few labels.
    """
    return look_up(df, _renamed(index, label, output, by), [*by, label])


def with_index_of_counts(counts: DataFrame, by: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """A class distribution with the index of each label, by a plain join of two tables of one row per label."""
    return counts.join(_renamed(index_of_counts(counts, by=by), LABEL, INDEXED_LABEL, by), [*by, LABEL], "left")


def _renamed(index: DataFrame, label: str, output: str, by: Sequence[str]) -> DataFrame:
    return index.select(*by, F.col(LABEL).alias(label), F.col(INDEXED_LABEL).alias(output))
