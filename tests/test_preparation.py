"""Schema, text source, cleaning steps and the audit on small hand-made rows."""

import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sensorflow.catalog.samples import sensor_samples
from sensorflow.operators.audit import cleaning_counts, cleaning_report, stored_counts
from sensorflow.operators.derive import feature_columns, name_labels, subtract_baseline
from sensorflow.operators.clean import drop_columns_like, drop_transient, missing_to_null, transient_rows
from sensorflow.plans.prepare import clean, label_and_fill, prepare
from sensorflow.schema import ACTIVITY_NAMES, RESTING_HEART_RATE, SENSOR_COLUMNS, SENSOR_SCHEMA
from sensorflow.sources.dimensions import check_subjects, resting_heart_rate
from sensorflow.sources.storage import read_by_subject, shared_folder
from sensorflow.sources.text import ingest_changed_files, ingest_subject_files, read_ingested, read_manifest, parse_lines, read_subject_files, with_line_order


def line(time, activity, heart_rate, fields=51, **changed):
    sensors = {name: "NaN" if "orientation" in name else "1.5" for name in SENSOR_COLUMNS}
    sensors.update(changed)
    return " ".join([str(time), str(activity), str(heart_rate), *list(sensors.values())[:fields]])


@pytest.fixture
def recordings(tmp_path):
    folder = tmp_path / "recordings"
    folder.mkdir()
    (folder / "subject101.dat").write_text(
        "\n".join(
            [
                line(0.0, 1, 100),
                line(0.01, 1, "NaN"),
                line(0.02, 0, 180),
                line(0.03, 4, "NaN"),
                line(0.04, 40, 90),
                line(0.05, "x", 90),
                line(0.06, 2, 90, IMU_hand_3Dacc_2="NaN"),
                line(0.07, 3, 90, fields=50),
                line(0.08, 3, 90, fields=20),
                line(0.09, 16, "oops"),
            ]
        )
        + "\n"
    )
    (folder / "subject108.dat").write_text(line(1.0, 24, "NaN") + "\n" + line(1.1, 24, 70) + "\n")
    (folder / "notes.txt").write_text("not a recording\n")
    return str(folder)


def test_schema_follows_the_recording_format():
    assert len(SENSOR_SCHEMA) == 54
    assert SENSOR_SCHEMA.names[:5] == ["timestamp", "activityID", "heart_rate", "IMU_hand_temperature_1", "IMU_hand_3Dacc_2"]
    assert SENSOR_SCHEMA.names[-1] == "IMU_ankle_orientation_17"
    assert SENSOR_SCHEMA["activityID"].dataType.simpleString() == "int"
    assert len(ACTIVITY_NAMES) == 25 and len(RESTING_HEART_RATE) == 9


def test_scan_takes_the_subject_from_the_file(spark, recordings):
    rows = read_subject_files(spark, recordings)
    assert {r.subject: r["count"] for r in rows.groupBy("subject").count().collect()} == {"subject101": 10, "subject108": 2}
    by_time = {r.timestamp: r for r in rows.collect()}
    assert math.isnan(by_time[0.01].heart_rate)
    assert by_time[0.05].activityID is None
    assert by_time[0.09].heart_rate is None
    assert by_time[0.08].IMU_ankle_3Dacc_2 is None


def test_parsed_lines_equal_the_scan(spark, recordings):
    scanned = read_subject_files(spark, recordings).select("subject", *SENSOR_SCHEMA.names)
    lines = spark.read.text(recordings, pathGlobFilter="*.dat").select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)\.dat$", 1).alias("subject"), "value"
    )
    parsed = parse_lines(lines)
    assert parsed.columns == scanned.columns
    assert parsed.exceptAll(scanned).count() == 0 and scanned.exceptAll(parsed).count() == 0


def test_audit_and_prepared_rows(spark, recordings, tmp_path):
    samples = ingest_subject_files(spark, recordings, str(tmp_path / "samples"))
    tiebreak = ["file_offset", "line_order"]
    prepared = prepare(samples, tiebreak)
    rows = {(r.subject, r.timestamp): r for r in prepared.collect()}
    # The transient 180 feeds nothing; the missing readings take the 100 and the
    # 90 before them; a row short of its last orientation field is kept.
    assert {key: r.heart_rate for key, r in rows.items()} == {
        ("subject101", 0.0): 100.0,
        ("subject101", 0.01): 100.0,
        ("subject101", 0.03): 100.0,
        ("subject101", 0.07): 90.0,
        ("subject101", 0.09): 90.0,
        ("subject108", 1.1): 70.0,
    }
    assert rows[("subject101", 0.09)].label == "vacuum_cleaning"
    assert rows[("subject108", 1.1)].heart_rate_minus_rest == 4.0
    assert rows[("subject101", 0.0)].avg_temperature == 1.5
    counts = {r.subject: r for r in cleaning_counts(samples, tiebreak).collect()}
    assert tuple(counts["subject101"])[1:] == (10, 1, 8, 5)
    assert tuple(counts["subject108"])[1:] == (2, 0, 2, 1)
    report = {(r.subject, r.measure): r.value for r in cleaning_report(cleaning_counts(samples, tiebreak)).collect()}
    assert report[("subject101", "After_activityID=0_Remove")] == 8


def test_columns_through_the_steps(spark, recordings):
    samples = read_subject_files(spark, recordings).drop("file_offset")
    assert len(drop_columns_like(samples).columns) == 42 + 1
    prepared = prepare(samples, [])
    assert len(prepared.columns) == 45 + 1
    features = feature_columns(prepared)
    assert len(features) == 42
    assert features == [c for c in prepared.columns if c not in ("subject", "timestamp", "activityID", "label")]


def test_line_order_follows_the_file_over_many_splits(spark, tmp_path):
    (tmp_path / "subject105.dat").write_text("\n".join(line(7.0, 1, i) for i in range(3000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = with_line_order(drop_transient(read_subject_files(spark, str(tmp_path))))
        assert rows.select("file_offset").distinct().count() > 5
        ordered = rows.orderBy("timestamp", "file_offset", "line_order").select("heart_rate").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.heart_rate for r in ordered] == [float(i) for i in range(3000)]


def test_audit_equals_the_steps_one_by_one(spark, sf_dir):
    samples = sensor_samples(spark, sf_dir)
    tiebreak = ["event_id"]
    for rows_per_task in (None, 20):
        counts = cleaning_counts(samples, tiebreak, rows_per_task=rows_per_task)
        total = counts.agg(F.sum("all_rows"), F.sum("transient_rows"), F.sum("kept_rows"), F.sum("complete_rows")).first()
        assert tuple(total) == (
            samples.count(),
            transient_rows(samples).count(),
            drop_transient(samples).count(),
            prepare(samples, tiebreak, rows_per_task=rows_per_task).count(),
        )


def test_counts_of_stored_rows_equal_the_audit(spark, sf_dir):
    # Subject `none` has only transient rows.
    samples = sensor_samples(spark, sf_dir)
    samples = samples.union(samples.filter("activityID = 0").withColumn("subject", F.lit("none")))
    stored = stored_counts(samples, prepare(samples.filter("subject != 'none'"), ["event_id"]))
    counts = cleaning_counts(samples, ["event_id"])
    assert sorted(stored.collect()) == sorted(counts.collect())
    assert stored.filter("subject = 'none'").first().complete_rows == 0


def test_null_and_unknown_codes(spark):
    df = spark.createDataFrame([(0,), (1,), (16,), (99,), (None,)], "activityID int")
    assert [r.activityID for r in drop_transient(df).collect()] == [1, 16, 99]
    assert [r.activityID for r in transient_rows(df).collect()] == [0]
    assert [r.label for r in name_labels(df).collect()] == ["Zero_Remove", "lying", "vacuum_cleaning", None, None]
    assert name_labels(df, trim=False).collect()[2].label == " vacuum_cleaning"


def test_missing_marks_by_type(spark):
    df = spark.createDataFrame([("NA", float("nan"), 1), ("x", 2.0, None)], "s string, d double, i int")
    assert [tuple(r) for r in missing_to_null(df).collect()] == [(None, None, 1), ("x", 2.0, None)]


def test_baseline_as_mapping_and_as_table(spark):
    df = spark.createDataFrame([("subject101", 80.0), ("subject109", 60.0)], "subject string, heart_rate double")
    mapped = subtract_baseline(df, RESTING_HEART_RATE)
    joined = subtract_baseline(df, resting_heart_rate(spark))
    assert sorted(mapped.collect()) == sorted(joined.select(mapped.columns).collect())


def test_unknown_subject_is_an_error(spark):
    df = spark.createDataFrame([("subject101",), ("stranger",)], "subject string")
    with pytest.raises(KeyError, match="stranger"):
        check_subjects(df, RESTING_HEART_RATE)
    with pytest.raises(KeyError, match="stranger"):
        check_subjects(df, resting_heart_rate(spark))
    check_subjects(df.filter("subject = 'subject101'"), RESTING_HEART_RATE)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
    cluster = SimpleNamespace(
        conf={"spark.checkpoint.dir": "/shared/place/"}, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None)
    )
    assert shared_folder(cluster, "x").startswith("/shared/place/x-")
    cluster.conf = {}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster, "x")


def test_label_and_fill_keeps_incomplete_rows(spark, sf_dir):
    samples = sensor_samples(spark, sf_dir)
    assert label_and_fill(clean(samples), ["event_id"]).count() == drop_transient(samples).count()


def test_stored_rows_are_pruned_by_subject(spark, recordings, tmp_path):
    ingest_subject_files(spark, recordings, str(tmp_path / "samples"))
    stored = read_by_subject(spark, str(tmp_path / "samples")).filter("subject = 'subject108'")
    assert stored.count() == 2
    assert "PartitionFilters: [isnotnull(subject" in stored._jdf.queryExecution().toString()


def with_subjects(spark, sf_dir, rule):
    """Samples whose subject is given by a SQL rule on the event id."""
    return sensor_samples(spark, sf_dir).withColumn("subject", F.expr(rule))


@pytest.mark.parametrize(
    "rule", ["CASE WHEN event_id % 2 = 0 THEN 'stranger' ELSE 'subject101' END", "CASE WHEN event_id % 2 = 0 THEN 'NA' ELSE 'subject101' END", "CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'subject101' END"]
)
def test_unknown_subjects_are_an_error_or_incomplete(spark, sf_dir, rule):
    samples = with_subjects(spark, sf_dir, rule)
    with pytest.raises(Exception, match="no baseline for subject"):
        prepare(samples, ["event_id"]).count()
    rows = prepare(samples, ["event_id"], strict=False)
    counts = {r.subject: r.complete_rows for r in cleaning_counts(samples, ["event_id"]).collect()}
    assert {r["subject"]: r["count"] for r in rows.groupBy("subject").count().collect()} == {s: n for s, n in counts.items() if n}
    assert len(counts) == 2


def test_subject_called_like_a_missing_value_is_prepared(spark, sf_dir):
    samples = with_subjects(spark, sf_dir, "'NA'")
    baseline = {"NA": 60}
    counts = cleaning_counts(samples, ["event_id"], baseline=baseline).first()
    assert (counts.subject, counts.complete_rows) == ("NA", prepare(samples, ["event_id"], baseline=baseline).count())


def test_doubled_and_null_baselines(spark):
    df = spark.createDataFrame([("a", 80.0), ("b", 60.0)], "subject string, heart_rate double")
    doubled = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "subject string, resting_hr int")
    with pytest.raises(ValueError, match="two baselines"):
        check_subjects(df, doubled)
    with pytest.raises(Exception, match="two baselines for subject a"):
        subtract_baseline(df, doubled).collect()
    empty = spark.createDataFrame([("a", 1, 0), ("b", None, 0)], "subject string, resting_hr int, other int")
    with pytest.raises(KeyError, match="b"):
        check_subjects(df, empty.drop("other"))
    with pytest.raises(Exception, match="no baseline for subject b"):
        subtract_baseline(df, empty, strict=True, column="resting_hr").collect()
    with pytest.raises(ValueError, match="name the baseline column"):
        subtract_baseline(df, empty)


def test_subject_names_survive_paths(spark, tmp_path):
    for name in ("subject 1", "a+b", "001"):
        (tmp_path / f"{name}.dat").write_text("0.0 1 100\n")
    stored = ingest_subject_files(spark, str(tmp_path), str(tmp_path / "out"))
    names = {"subject 1", "a+b", "001"}
    assert {r.subject for r in stored.collect()} == names
    assert {r.subject for r in read_by_subject(spark, str(tmp_path / "out")).collect()} == names
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.txt").write_text("0.0 1 100\n")
    with pytest.raises(Exception, match="no subject in the file path"):
        read_subject_files(spark, str(tmp_path / "other"), file_glob="*.txt").select("subject").collect()


def test_bad_lines_are_rescued_and_counted(spark, recordings, tmp_path):
    samples = ingest_subject_files(spark, recordings, str(tmp_path / "rows"), rescue=True)
    bad = {r.timestamp: r.bad_line for r in samples.filter("bad_line IS NOT NULL").collect()}
    assert sorted(bad) == [0.05, 0.07, 0.08, 0.09] and bad[0.09] == line(0.09, 16, "oops")
    tiebreak = ["file_offset", "line_order"]
    counted = {r.subject: r.bad_lines for r in cleaning_counts(samples, tiebreak).collect()}
    assert counted == {"subject101": 4, "subject108": 0}
    plain = with_line_order(read_subject_files(spark, recordings))
    report = lambda rows: sorted(map(tuple, cleaning_report(cleaning_counts(rows, tiebreak)).collect()))
    assert report(samples) == report(plain)
    assert set(prepare(samples, tiebreak).columns) == set(prepare(plain, tiebreak).columns)
    assert prepare(samples, tiebreak).count() == prepare(plain, tiebreak).count()
    stored = stored_counts(samples, prepare(samples, tiebreak))
    assert {r.subject: r.bad_lines for r in stored.collect()} == counted


def test_only_added_and_changed_files_are_parsed_again(spark, recordings, tmp_path):
    from pathlib import Path

    folder, target = Path(recordings), str(tmp_path / "table")
    rows = lambda df: sorted((r.subject, r.timestamp, r.ingest) for r in df.collect())
    first = ingest_changed_files(spark, recordings, target)
    assert len(rows(first)) == 12 and {r[2] for r in rows(first)} == {1}
    assert rows(ingest_changed_files(spark, recordings, target)) == rows(first)
    (folder / "subject102.dat").write_text(line(5.0, 1, 80) + "\n")
    (folder / "subject108.dat").write_text(line(1.0, 24, 60) + "\n")
    # An ingest that stopped before its entries were written.
    first.limit(1).drop("ingest").write.parquet(f"{target}/rows/ingest=2")
    second = rows(ingest_changed_files(spark, recordings, target))
    assert [r for r in second if r[0] != "subject101"] == [("subject102", 5.0, 2), ("subject108", 1.0, 2)]
    assert [r for r in second if r[0] == "subject101"] == [r for r in rows(first) if r[0] == "subject101"]
    assert sorted(r.ingest for r in read_manifest(spark, target).collect()) == [1, 2, 2]
    assert rows(read_ingested(spark, target)) == second
