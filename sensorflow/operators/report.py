"""Long-format report tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

REPORTS = ("Per_class", "Per_Subject", "Cleaning")


def to_measures(wide: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """One row per key and measure; ``measures`` maps columns to measure names."""
    named = wide.select(*keys, *[wide[column].alias(name) for column, name in measures.items()])
    return named.unpivot(list(keys), list(measures.values()), "measure", "value")


def append_measures(report: DataFrame, more: DataFrame) -> DataFrame:
    return report.unionByName(more)


def select_report(reports: Mapping[str, Callable[[], DataFrame]], kind: str = "Per_class") -> DataFrame:
    """Build the wanted report only."""
    if kind not in REPORTS:
        raise ValueError(f"unknown report {kind!r}, choose from {REPORTS}")
    return reports[kind]()
