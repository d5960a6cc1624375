"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`shapes` times single-task or many-job forms of the same results for comparison;
they are not part of `value`.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorflow.catalog.preparation import LINE_KEYS, line_gaps
from sensorflow.catalog.registry import QUERIES
from sensorflow.catalog.samples import sensor_samples
from sensorflow.operators.clean import drop_incomplete, drop_transient
from sensorflow.plans.prepare import clean, label_and_fill
from sensorflow.session import local_session

HEADLINE = [
    "delimited_scan_S2",
    "forward_fill_W1",
    "supplier_forward_fill_W1",
    "long_series_forward_fill_W1",
    "cleaning_report_A18",
    "prepared_samples_J1",
    "class_report_A19",
    "line_report_A20",
    "feature_vectors_M2",
    "held_out_predictions_M4_M7",
    "line_predictions_M4_M7",
    "subject_runs_J1",
]
RUNS = 2


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def fill_in_one_window(spark, sf_dir):
    """The two long series filled by one window over one task."""
    frame = Window.orderBy("l_linestatus", *LINE_KEYS).rowsBetween(-20, 0)
    drain(line_gaps(spark, sf_dir).withColumn("reading", F.last("reading", ignorenulls=True).over(frame)))


def audit_by_counting(spark, sf_dir):
    """The cleaning counts as one job per stage."""
    samples = sensor_samples(spark, sf_dir)
    kept = drop_transient(samples)
    labelled = label_and_fill(clean(samples), ["event_id"], rows_per_task=None)
    complete = drop_incomplete(labelled)
    for stage in (samples, kept, labelled, complete):
        stage.groupBy("subject").count().collect()


SHAPES = {"fill_in_one_window": fill_in_one_window, "audit_by_counting": audit_by_counting}


def best_time(work) -> float:
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        work()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    with tempfile.TemporaryDirectory() as folder:
        measure(sf_dir, local_session(os.environ.get("BENCH_CPUS", "8"), folder=f"file://{folder}"))


def measure(sf_dir: str, spark) -> None:
    seconds = {name: best_time(lambda: drain(QUERIES[name](spark, sf_dir))) for name in HEADLINE}
    shapes = {name: best_time(lambda: shape(spark, sf_dir)) for name, shape in SHAPES.items()}
    result = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "shapes": shapes,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
