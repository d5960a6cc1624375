"""Column expressions for missing values and row hashes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for a missing value.
MISSING_TEXTS = ("NULL", "NA", "NaN")
FLOATING = ("double", "float")


def null_if_missing(name: str, dtype: str) -> Column:
    """The column with its missing-value marks as null, by type."""
    column = F.col(name)
    if dtype in FLOATING:
        return F.when(~F.isnan(column), column).alias(name)
    if dtype == "string":
        return F.when(~column.isin(*MISSING_TEXTS), column).alias(name)
    return column


def is_present(name: str, dtype: str) -> Column:
    """Neither null nor NaN."""
    present = F.col(name).isNotNull()
    return present & ~F.isnan(name) if dtype in FLOATING else present


def all_present(df: DataFrame, columns: Sequence[str]) -> Column:
    """True when none of the columns is null or NaN; what `dropna` keeps."""
    dtypes = dict(df.dtypes)
    return reduce(Column.__and__, (is_present(c, dtypes[c]) for c in columns), F.lit(True))


def row_hash(key: Sequence[str]) -> Column:
    """32-bit hash of the key columns, the same in any SQL engine with md5."""
    text = F.concat_ws("|", *[F.col(name).cast("string") for name in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
