"""From raw samples of all subjects to complete feature rows, in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from sensorflow.operators.clean import drop_columns_like, drop_incomplete, drop_transient, missing_to_null
from sensorflow.operators.derive import mean_temperature, name_labels, subtract_baseline
from sensorflow.operators.impute import ROWS_PER_TASK, forward_fill
from sensorflow.schema import BAD_LINE, FILL_ROWS, HEART_RATE, RESTING_HEART_RATE, SOURCE_FILE, SUBJECT, TIME

# Columns that tell where a sample comes from; a good line has no text of a bad one.
NOT_SAMPLED = (BAD_LINE, SOURCE_FILE)


def clean(samples: DataFrame) -> DataFrame:
    return drop_columns_like(drop_transient(samples)).drop(*NOT_SAMPLED)


def label_and_fill(
    cleaned: DataFrame,
    tiebreak: Sequence[str],
    baseline: Mapping | DataFrame = RESTING_HEART_RATE,
    rows: int = FILL_ROWS,
    rows_per_task: int | None = ROWS_PER_TASK,
    strict: bool = True,
) -> DataFrame:
    """Nulls, heart-rate fill, residual and label; incomplete rows still present.

    A subject without a baseline is an error when its rows are read. With
    ``strict=False`` its residuals are null and its rows incomplete.
    """
    nulled = missing_to_null(cleaned, [SUBJECT, *tiebreak])
    filled = forward_fill(nulled, HEART_RATE, [SUBJECT], [TIME, *tiebreak], rows, rows_per_task)
    return name_labels(subtract_baseline(filled, baseline, strict=strict))


def prepare(samples: DataFrame, tiebreak: Sequence[str], **options) -> DataFrame:
    """Clean, fill, derive and label; only complete rows remain.

    The fill comes after the transient rows are gone and before incomplete rows
    are dropped: its 20 rows are counted over exactly the rows in between.
    """
    return mean_temperature(drop_incomplete(label_and_fill(clean(samples), tiebreak, **options)))
