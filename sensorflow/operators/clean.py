"""Row and column cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorflow.functions.values import null_if_missing
from sensorflow.schema import ACTIVITY, DROPPED_QUANTITY, TRANSIENT_CODE


def drop_transient(df: DataFrame, activity: str = ACTIVITY, code: int = TRANSIENT_CODE) -> DataFrame:
    """Rows of a real activity; a null activity goes too."""
    return df.filter(F.col(activity) != code)


def transient_rows(df: DataFrame, activity: str = ACTIVITY, code: int = TRANSIENT_CODE) -> DataFrame:
    return df.filter(F.col(activity) == code)


def drop_columns_like(df: DataFrame, part: str = DROPPED_QUANTITY) -> DataFrame:
    """Drop every column whose name contains ``part``."""
    return df.drop(*[name for name in df.columns if part in name])


def missing_to_null(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """NaN in numbers and the missing-value texts in strings become null; ``keys`` stay as they are."""
    return df.select(*[F.col(name) if name in keys else null_if_missing(name, dtype) for name, dtype in df.dtypes])


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without null or NaN in the given (default: all) columns."""
    return df.dropna(how="any", subset=list(columns) if columns else None)


def preview(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], rows: int = 20) -> DataFrame:
    """The first rows of some columns in a total order."""
    return df.orderBy(*order_by).limit(rows).select(*columns)
