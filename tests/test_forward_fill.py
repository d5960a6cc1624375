"""The forward fill: edge rows, and chunked against a plain loop."""

import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorflow.operators.clean import drop_transient, missing_to_null
from sensorflow.operators.impute import MAX_CHUNKS, _cut_points, _long_series, _with_chunk, forward_fill

SCHEMA = "subject string, timestamp double, row int, heart_rate double"


def fill_by_loop(rows, frame):
    series = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        series[row[0]].append(row)
    filled = {}
    for subject, members in series.items():
        for i, row in enumerate(members):
            values = [m[3] for m in members[max(0, i - frame) : i + 1] if m[3] is not None]
            filled[(subject, row[2])] = values[-1] if values else None
    return filled


def fill(spark, samples, **options):
    df = forward_fill(spark.createDataFrame(samples, SCHEMA), order_by=["timestamp", "row"], **options)
    return {(r.subject, r.row): r.heart_rate for r in df.collect()}


def gap(length, after=None):
    return [("a", float(i), i, 1.0 if i == 0 else None) for i in range(length + 1)]


@pytest.mark.parametrize("rows_per_task", [None, 1000, 5, 1])
def test_twenty_missing_rows_are_filled_and_the_next_is_not(spark, rows_per_task):
    filled = fill(spark, gap(21), rows_per_task=rows_per_task)
    assert filled[("a", 20)] == 1.0
    assert filled[("a", 21)] is None


@pytest.mark.parametrize("rows_per_task", [None, 3])
def test_leading_gap_stays(spark, rows_per_task):
    rows = [("a", float(i), i, None if i < 5 else 2.0) for i in range(10)]
    filled = fill(spark, rows, rows_per_task=rows_per_task)
    assert [filled[("a", i)] for i in range(10)] == [None] * 5 + [2.0] * 5


@pytest.mark.parametrize("rows_per_task", [None, 2])
def test_tiebreak_orders_equal_times(spark, rows_per_task):
    rows = [("a", 1.0, 1, 5.0), ("a", 1.0, 2, None), ("a", 1.0, 0, None), ("a", 1.0, 3, 7.0), ("a", 1.0, 4, None)]
    filled = fill(spark, rows, rows_per_task=rows_per_task)
    assert [filled[("a", i)] for i in range(5)] == [None, 5.0, 5.0, 7.0, 7.0]


def test_nan_must_become_null_first(spark):
    rows = [("a", 0.0, 0, 3.0), ("a", 1.0, 1, float("nan"))]
    df = missing_to_null(spark.createDataFrame(rows, SCHEMA))
    assert [r.heart_rate for r in forward_fill(df, order_by=["timestamp", "row"]).orderBy("row").collect()] == [3.0, 3.0]


def test_removed_rows_feed_nothing_and_do_not_count(spark):
    schema = "subject string, timestamp double, activityID int, heart_rate double"
    rows = [("a", 0.0, 1, 1.0)] + [("a", float(i), 0, 9.0) for i in range(1, 40)] + [("a", 50.0, 1, None)]
    kept = drop_transient(spark.createDataFrame(rows, schema))
    assert [r.heart_rate for r in forward_fill(kept).orderBy("timestamp").collect()] == [1.0, 1.0]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), rows_per_task=st.integers(1, 60), frame=st.integers(1, 25), filled=st.sampled_from([2, 10, 30, 80]))
def test_chunks_equal_the_loop(spark, seed, rows_per_task, frame, filled):
    draw = random.Random(seed)
    # One series holds most rows, one has no name, times repeat.
    rows = [
        (draw.choice(["hot", "hot", "hot", "hot", "b", None]), float(draw.randrange(60)), i,
         float(i) if draw.randrange(filled) == 0 else None)
        for i in range(draw.randrange(1, 500))
    ]
    assert fill(spark, rows, rows_per_task=rows_per_task, rows=frame) == fill_by_loop(rows, frame)


def test_null_order_values_come_first_in_chunks_too(spark):
    rows = [("a", None if i < 30 else float(i), i, float(i) if i % 13 == 0 else None) for i in range(80)]
    assert fill(spark, rows, rows_per_task=7) == fill(spark, rows, rows_per_task=None)


def test_text_order_keys_can_be_cut(spark):
    rows = [("a", f"k{i:04d}", float(i) if i % 9 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "subject string, k string, heart_rate double")
    plain = forward_fill(df, order_by=["k"], rows_per_task=None).orderBy("k").collect()
    assert forward_fill(df, order_by=["k"], rows_per_task=11).orderBy("k").collect() == plain


def test_series_and_order_may_be_times(spark):
    # Series a microsecond apart: a cut of the long one must not fall into its neighbours.
    df = spark.range(600).selectExpr(
        "timestamp_micros(1700000000000000 + CASE WHEN id % 6 < 4 THEN 5 ELSE id % 6 END) AS series",
        "cast(timestamp_micros(1700000000000000 + id) AS timestamp_ntz) AS at",
        "CASE WHEN id % 37 = 0 THEN cast(id AS double) END AS heart_rate",
    )
    plain = forward_fill(df, by=["series"], order_by=["at"], rows_per_task=None)
    chunked = forward_fill(df, by=["series"], order_by=["at"], rows_per_task=150)
    assert chunked.exceptAll(plain).isEmpty()
    assert plain.exceptAll(chunked).isEmpty()


def test_the_number_of_chunks_is_bounded(spark):
    df = spark.range(10_000).selectExpr("CASE WHEN id < 9000 THEN 'hot' ELSE 's' || CAST(id AS STRING) END AS subject")
    series, target = _long_series(df, ["subject"], rows_per_task=10, max_chunks=100)
    assert target == 90
    assert [row["subject"] for row in series] == ["hot"]
    assert _long_series(df, ["subject"], 9000, MAX_CHUNKS)[0] == []


def test_chunks_are_about_the_wanted_size(spark):
    df = spark.range(60_000).selectExpr("'hot' AS subject", "id")
    hot = df.select(F.col("subject").alias("_by_subject")).distinct()
    cuts, size = _cut_points(df, ["subject"], ["id"], hot, 5_000)
    sizes = [r["count"] for r in _with_chunk(df, ["subject", "id"], cuts, size).groupBy("_chunk").count().collect()]
    assert sum(sizes) == 60_000
    assert max(sizes) < 20_000


def test_a_long_series_gives_every_core_work(spark):
    rows = 2_400_000
    df = spark.range(rows).selectExpr("'hot' AS subject", "id", "CASE WHEN id % 30 = 0 THEN id END AS heart_rate")
    filled = forward_fill(df, order_by=["id"]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count("heart_rate").alias("known")).collect()
    assert sum(r.n for r in filled) == rows and sum(r.known for r in filled) == rows // 30 * 21
    assert max(r.n for r in filled) < rows / 2 and len(filled) >= 4
