"""Row counts of the cleaning steps, all stages in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorflow.functions.values import all_present
from sensorflow.operators.clean import missing_to_null
from sensorflow.operators.derive import with_baseline
from sensorflow.operators.impute import ROWS_PER_TASK, forward_fill
from sensorflow.operators.report import to_measures
from sensorflow.schema import (
    ACTIVITY,
    ACTIVITY_NAMES,
    BAD_LINE,
    DROPPED_QUANTITY,
    FILL_ROWS,
    HEART_RATE,
    RESTING_HEART_RATE,
    SOURCE_FILE,
    SUBJECT,
    TIME,
    TRANSIENT_CODE,
)

# Measure names of the cleaning report.
CLEANING_MEASURES = {
    "all_rows": "All_Values",
    "kept_rows": "After_activityID=0_Remove",
    "complete_rows": "AfterNaNRemove",
}


def cleaning_counts(
    samples: DataFrame,
    tiebreak: Sequence[str],
    names: Mapping[int, str] = ACTIVITY_NAMES,
    subject: str = SUBJECT,
    time: str = TIME,
    activity: str = ACTIVITY,
    signal: str = HEART_RATE,
    rows: int = FILL_ROWS,
    rows_per_task: int | None = ROWS_PER_TASK,
    baseline: Mapping | DataFrame = RESTING_HEART_RATE,
) -> DataFrame:
    """Per subject: all rows, transient rows, rows kept, rows complete after the fill.

    A row of a subject without a baseline is incomplete: it has no residual.

    Kept and transient rows form separate series, so a transient row never feeds
    the fill. Whether the other columns are complete is decided before the
    shuffle, which then carries one flag instead of all sensor columns. Where
    bad lines were rescued, they are counted, too.
    """
    others = [c for c in samples.columns if DROPPED_QUANTITY not in c and c not in (signal, BAD_LINE, SOURCE_FILE)]
    rescued = [F.col(BAD_LINE).isNotNull().alias("bad")] if BAD_LINE in samples.columns else []
    named = _is_true(F.col(activity).isin(*names))
    flagged = missing_to_null(
        samples.select(
            subject,
            time,
            *tiebreak,
            signal,
            _is_true(F.col(activity) == TRANSIENT_CODE).alias("transient"),
            _is_true(F.col(activity) != TRANSIENT_CODE).alias("kept"),
            (all_present(samples, others) & named).alias("complete"),
            *rescued,
        ),
        [subject, *tiebreak],
    )
    filled = forward_fill(flagged, signal, [subject, "kept"], [time, *tiebreak], rows, rows_per_task)
    counts = filled.groupBy(subject).agg(
        F.count("*").alias("all_rows"),
        F.count_if("transient").alias("transient_rows"),
        F.count_if("kept").alias("kept_rows"),
        F.count_if(F.col("kept") & F.col("complete") & F.col(signal).isNotNull()).alias("complete_rows"),
        *([F.count_if("bad").alias("bad_lines")] if rescued else []),
    )
    complete = F.when(F.col("_level").isNotNull(), F.col("complete_rows")).otherwise(0)
    return with_baseline(counts, baseline, "_level", subject).withColumn("complete_rows", complete).drop("_level")


def stored_counts(samples: DataFrame, prepared: DataFrame, subject: str = SUBJECT, activity: str = ACTIVITY) -> DataFrame:
    """The same counts where the prepared rows are stored already: two narrow counts, no fill."""
    read = samples.groupBy(subject).agg(
        F.count("*").alias("all_rows"),
        F.count_if(F.col(activity) == TRANSIENT_CODE).alias("transient_rows"),
        F.count_if(F.col(activity) != TRANSIENT_CODE).alias("kept_rows"),
        *([F.count(BAD_LINE).alias("bad_lines")] if BAD_LINE in samples.columns else []),
    )
    complete = prepared.groupBy(subject).agg(F.count("*").alias("complete_rows"))
    return read.join(complete, subject, "left").fillna(0, ["complete_rows"])


def _is_true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def cleaning_report(counts: DataFrame, subject: str = SUBJECT) -> DataFrame:
    return to_measures(counts, [subject], CLEANING_MEASURES)
