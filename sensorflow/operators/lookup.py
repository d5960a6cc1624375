"""Lookups in tables of unknown size whose keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000
HOT_KEYS = 1_000


def look_up(df: DataFrame, table: DataFrame, on: Sequence[str], most_rows: int = BROADCAST_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Left join with a table that has one row per key; null keys find nothing.

    The table's rows are counted first. Up to ``most_rows`` are broadcast. Of a larger table, the rows of the ``hot_keys`` most
    frequent keys of ``df`` are broadcast; every other key has less than one in ``hot_keys`` rows, so they are joined by shuffle
    and no task gets a hot key.
    """
    on = list(on)
    values = [name for name in table.columns if name not in on]
    entries = table.select(*[F.col(f"`{name}`").alias(f"_on_{name}") for name in on], *[f"`{name}`" for name in values])
    if table.limit(most_rows + 1).count() <= most_rows:
        return df.join(F.broadcast(entries), _same(df, entries, on), "left").select(*_columns(df), *_columns(table, values))
    counts = df.groupBy(*[f"`{name}`" for name in on]).agg(F.count("*").alias("_rows"))
    hot = counts.orderBy(F.desc("_rows"), *[f"`{name}`" for name in on]).limit(hot_keys).drop("_rows")
    hot = hot.join(entries, _same(hot, entries, on), "left").select(*[hot[f"`{name}`"].alias(f"_hot_{name}") for name in on], *_columns(table, values), F.lit(True).alias("_hot"))
    at_hot = reduce(Column.__and__, (df[f"`{name}`"].eqNullSafe(hot[f"_hot_{name}"]) for name in on))
    first = df.join(F.broadcast(hot), at_hot, "left")
    found = first.filter(F.col("_hot")).select(*_columns(df), *_columns(table, values))
    rest = first.filter(F.col("_hot").isNull()).select(*_columns(df))
    return found.unionByName(rest.join(entries, _same(rest, entries, on), "left").select(*_columns(df), *_columns(table, values)))


def _same(df: DataFrame, entries: DataFrame, on: Sequence[str]) -> Column:
    return reduce(Column.__and__, (df[f"`{name}`"] == entries[f"`_on_{name}`"] for name in on))


def _columns(df: DataFrame, names: Sequence[str] | None = None) -> list[str]:
    return [f"`{name}`" for name in (df.columns if names is None else names)]
