"""Queries on sources, projections, cleaning counts and the forward fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.catalog import check_sql as sql
from sensorflow.catalog.samples import sample_lines, sensor_samples, table
from sensorflow.operators.audit import cleaning_counts, cleaning_report
from sensorflow.operators.clean import (
    drop_columns_like,
    drop_incomplete,
    drop_transient,
    missing_to_null,
    preview,
    transient_rows,
)
from sensorflow.operators.derive import feature_columns, mean_temperature, name_labels, subtract_baseline
from sensorflow.operators.impute import forward_fill
from sensorflow.operators.labels import class_distribution
from sensorflow.plans.prepare import clean, label_and_fill, prepare
from sensorflow.schema import ACTIVITY_NAMES, RESTING_HEART_RATE, SENSOR_SCHEMA
from sensorflow.sources.dimensions import activity_names, check_subjects, literal_map, resting_heart_rate
from sensorflow.sources.storage import shared_folder
from sensorflow.sources.text import FILE_OFFSET, LINE_ORDER, ingest_changed_files, ingest_subject_files, parse_lines, read_subject_files

TIEBREAK = ["event_id"]
ORDER = ["timestamp", "event_id"]
LINE_KEYS = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
LINE_GAPS = "CASE WHEN (l_orderkey + l_partkey) % 11 = 0 THEN l_quantity END"


def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the samples as text by subject into the shared folder and scan them."""
    folder = shared_folder(spark, "sample_text")
    sample_lines(sensor_samples(spark, sf_dir)).write.partitionBy("subject").text(folder)
    return read_subject_files(spark, folder, subject_pattern=r"/subject=([^/]+)/", file_glob="*.txt")


def subject_catalogue(spark, sf_dir):
    return text_samples(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("rows"))


def delimited_scan(spark, sf_dir):
    return text_samples(spark, sf_dir).select("subject", *SENSOR_SCHEMA.names)


# Lines with a field too few or too many, or with an activity that is no number.
BROKEN = "CASE event_id % 23 WHEN 3 THEN 'short' WHEN 5 THEN 'long' WHEN 7 THEN 'typed' ELSE 'good' END"


def rescued_lines(spark, sf_dir):
    """Cleaning counts of scanned text with injected bad lines, those counted."""
    samples = sensor_samples(spark, sf_dir)
    fields = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in SENSOR_SCHEMA.names]
    broken = F.expr(BROKEN)
    typed = [F.when(broken == "typed", F.lit("x")).otherwise(field) if name == "activityID" else field for name, field in zip(SENSOR_SCHEMA.names, fields)]
    line = F.when(broken == "short", F.concat_ws(" ", *fields[:-1])).when(broken == "long", F.concat_ws(" ", *fields, F.lit("1"))).otherwise(F.concat_ws(" ", *typed))
    folder = shared_folder(spark, "broken_text")
    samples.select("subject", line.alias("value")).write.partitionBy("subject").text(f"{folder}/text")
    rows = ingest_subject_files(spark, f"{folder}/text", f"{folder}/rows", subject_pattern=r"/subject=([^/]+)/", file_glob="*.txt", rescue=True)
    return cleaning_counts(rows, [FILE_OFFSET, LINE_ORDER]).select("subject", "all_rows", "transient_rows", "kept_rows", "bad_lines")


def changed_files(spark, sf_dir):
    """Rows per subject and the ingest they came with: the second ingest finds new files of four subjects."""
    folder = shared_folder(spark, "grown_text")
    samples = sensor_samples(spark, sf_dir)
    options = {"subject_pattern": r"/subject=([^/]+)/", "file_glob": "*.txt"}
    for part in (F.col("subject") < "subject106", F.col("subject") >= "subject106"):
        sample_lines(samples.filter(part)).write.mode("append").partitionBy("subject").text(f"{folder}/text")
        rows = ingest_changed_files(spark, f"{folder}/text", f"{folder}/table", **options)
    return rows.groupBy("subject", "ingest").agg(F.count("*").alias("rows"))


def parsed_lines(spark, sf_dir):
    return parse_lines(sample_lines(sensor_samples(spark, sf_dir)))


def schema_columns(spark, sf_dir):
    """Position, name, type and filled rows of every source column, from the scanned text."""
    scanned = text_samples(spark, sf_dir)
    counted = scanned.agg(*[F.count(name).alias(name) for name in SENSOR_SCHEMA.names])
    long = counted.unpivot([], SENSOR_SCHEMA.names, "column_name", "filled_rows")
    types = literal_map({field.name: field.dataType.simpleString() for field in SENSOR_SCHEMA})
    places = literal_map({name: position for position, name in enumerate(SENSOR_SCHEMA.names)})
    name = F.col("column_name")
    return long.select("column_name", types[name].alias("column_type"), places[name].alias("position"), "filled_rows")


def resting_dimension(spark, sf_dir):
    samples = sensor_samples(spark, sf_dir).select("subject")
    check_subjects(samples, RESTING_HEART_RATE)
    counts = samples.groupBy("subject").agg(F.count("*").alias("rows"))
    return counts.join(resting_heart_rate(spark), "subject", "left")


def activity_dimension(spark, sf_dir):
    counts = sensor_samples(spark, sf_dir).groupBy(F.col("activityID").alias("activity_id")).agg(F.count("*").alias("rows"))
    return counts.join(activity_names(spark), "activity_id", "full")


def sample_preview(spark, sf_dir):
    filled = label_and_fill(clean(sensor_samples(spark, sf_dir)), TIEBREAK)
    return preview(filled, ["timestamp", "activityID", "heart_rate", "heart_rate_minus_rest"], ORDER)


def label_preview(spark, sf_dir):
    filled = label_and_fill(clean(sensor_samples(spark, sf_dir)), TIEBREAK)
    return preview(filled, ["timestamp", "activityID", "heart_rate", "label"], ORDER)


def narrow(df: DataFrame) -> DataFrame:
    return df.select("subject", "event_id", "activityID", "heart_rate")


def nulled_samples(spark, sf_dir):
    return missing_to_null(clean(sensor_samples(spark, sf_dir)))


def nulled_texts(spark, sf_dir):
    texts = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE event_id % 5 WHEN 0 THEN 'NULL' WHEN 1 THEN 'NA' WHEN 2 THEN 'NaN' ELSE event_type END AS event_type"
    )
    return missing_to_null(texts)


def residual(spark, sf_dir):
    cleaned = missing_to_null(drop_transient(sensor_samples(spark, sf_dir)))
    derived = subtract_baseline(cleaned, RESTING_HEART_RATE)
    return derived.select("subject", "event_id", "heart_rate_minus_rest")


def residual_from_table(spark, sf_dir):
    """The baseline as a table that grows with the data: quantity minus the supplier's balance."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), *LINE_KEYS)
    balances = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject"), "s_acctbal")
    derived = subtract_baseline(lines, balances, "l_quantity", "minus_balance")
    return derived.select("subject", "l_orderkey", "l_linenumber", "l_partkey", F.round("minus_balance", 6).alias("minus_balance"))


def average_temperature(spark, sf_dir):
    averaged = mean_temperature(drop_transient(sensor_samples(spark, sf_dir)))
    return averaged.select("subject", "event_id", F.round("avg_temperature", 6).alias("avg_temperature"))


def named_labels(spark, sf_dir):
    return name_labels(drop_transient(sensor_samples(spark, sf_dir))).select("subject", "event_id", "activityID", "label")


def selected_features(spark, sf_dir):
    """Sum and filled rows of each selected feature over the prepared rows."""
    prepared = prepare(sensor_samples(spark, sf_dir), TIEBREAK)
    names = feature_columns(prepared, ["subject", "event_id"])
    totals = prepared.select(*[F.struct(F.count(name).alias("rows"), F.sum(name).alias("total")).alias(name) for name in names])
    return totals.unpivot([], names, "feature", "found").select(
        "feature", "found.rows", F.round("found.total", 2).alias("total")
    )


def scalar_functions(spark, sf_dir):
    names = literal_map({code: name.strip() for code, name in ACTIVITY_NAMES.items()})
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").isin("click", "view").alias("member"),
        (~F.col("event_type").isin("click", "view")).alias("not_member"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("even_only"),
        F.round(F.col("value") - 60, 6).alias("minus_literal"),
        F.round((F.col("value") + F.col("event_id") + F.col("user_id")) / 3, 6).alias("mean_of_three"),
        names[(F.col("event_id") % 30).cast("int")].alias("looked_up"),
        F.expr("event_id % 7 != 0").alias("compared"),
    )


def row_counts(spark, sf_dir):
    return cleaning_counts(sensor_samples(spark, sf_dir), TIEBREAK).drop("transient_rows")


def transient_count(spark, sf_dir):
    return transient_rows(sensor_samples(spark, sf_dir)).groupBy("subject").agg(F.count_if(F.col("activityID") == 0).alias("transient_rows"))


def distribution(spark, sf_dir):
    return class_distribution(name_labels(clean(sensor_samples(spark, sf_dir))))


def filled_heart_rate(spark, sf_dir):
    cleaned = missing_to_null(drop_transient(narrow_samples(spark, sf_dir)))
    return forward_fill(cleaned, order_by=ORDER).select("subject", "event_id", "heart_rate")


def narrow_samples(spark, sf_dir):
    return sensor_samples(spark, sf_dir).select("subject", "event_id", "timestamp", "activityID", "heart_rate")


def line_gaps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linestatus", *LINE_KEYS, F.expr(LINE_GAPS).alias("reading"))


LINE_OUTPUT = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "reading"]


def supplier_fill(spark, sf_dir):
    filled = forward_fill(line_gaps(spark, sf_dir), "reading", ["l_suppkey"], LINE_KEYS)
    return filled.select("l_suppkey", *LINE_OUTPUT)


def long_series_fill(spark, sf_dir):
    """Two series that hold all rows, cut into chunks of about 5,000 rows."""
    filled = forward_fill(line_gaps(spark, sf_dir), "reading", ["l_linestatus"], LINE_KEYS, rows_per_task=5_000)
    return filled.select("l_linestatus", *LINE_OUTPUT)


def prepared_samples(spark, sf_dir):
    return prepare(sensor_samples(spark, sf_dir), TIEBREAK)


def audit_report(spark, sf_dir):
    return cleaning_report(cleaning_counts(sensor_samples(spark, sf_dir), TIEBREAK))


def _fill_sql(series: str) -> str:
    order = ", ".join(LINE_KEYS)
    return (
        f"SELECT {series}, l_orderkey, l_linenumber, l_partkey, l_quantity, last_value({LINE_GAPS} IGNORE NULLS) "
        f"OVER (PARTITION BY {series} ORDER BY {order} {sql.FRAME}) AS reading FROM lineitem"
    )


def _schema_sql() -> str:
    fields = [(f'"{field.name}"', field.name, field.dataType.simpleString()) for field in SENSOR_SCHEMA]
    return sql.steps() + " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, '{kind}' AS column_type, {position} AS position, count({column}) AS filled_rows FROM samples"
        for position, (column, name, kind) in enumerate(fields)
    )


def _features_sql() -> str:
    return sql.steps() + " UNION ALL ".join(
        f"SELECT '{name}' AS feature, count(*) AS rows, round(sum({name}), 2) AS total FROM prepared" for name in sql.FEATURES
    )


SCANNED = f"SELECT subject, {', '.join(chr(34) + name + chr(34) for name in SENSOR_SCHEMA.names)} FROM samples"

ENTRIES = {
    "subject_catalogue_S1": (subject_catalogue, sql.steps() + "SELECT subject, count(*) AS rows FROM samples GROUP BY 1"),
    "delimited_scan_S2": (delimited_scan, sql.steps() + SCANNED),
    "file_manifest_S1": (
        changed_files,
        sql.steps() + "SELECT subject, CAST(CASE WHEN subject < 'subject106' THEN 1 ELSE 2 END AS INT) AS ingest, count(*) AS rows FROM samples GROUP BY 1, 2",
    ),
    "rescued_lines_S2": (
        rescued_lines,
        sql.steps()
        + f"""SELECT subject, count(*) AS all_rows, count(*) FILTER (WHERE activityID = 0 AND {BROKEN} <> 'typed') AS transient_rows,
count(*) FILTER (WHERE activityID <> 0 AND {BROKEN} <> 'typed') AS kept_rows, count(*) FILTER (WHERE {BROKEN} <> 'good') AS bad_lines
FROM samples GROUP BY subject""",
    ),
    "line_parsing_S2": (parsed_lines, sql.steps() + SCANNED),
    "source_schema_S3": (schema_columns, _schema_sql()),
    "resting_dimension_S4": (
        resting_dimension,
        sql.steps() + f"SELECT subject, count(*) AS rows, resting_hr FROM samples LEFT JOIN {sql.RESTING} USING (subject) GROUP BY ALL",
    ),
    "activity_dimension_S5": (
        activity_dimension,
        sql.steps()
        + f"""SELECT coalesce(s.activityID, n.activity_id) AS activity_id, s.rows, n.label
FROM (SELECT activityID, count(*) AS rows FROM samples GROUP BY 1) s FULL JOIN {sql.NAMES} n ON s.activityID = n.activity_id""",
    ),
    "residual_preview_S6_O3": (
        sample_preview,
        sql.steps() + 'SELECT "timestamp", activityID, heart_rate, heart_rate_minus_rest FROM labelled ORDER BY "timestamp", event_id LIMIT 20',
    ),
    "label_preview_S6_O3": (
        label_preview,
        sql.steps() + 'SELECT "timestamp", activityID, heart_rate, label FROM labelled ORDER BY "timestamp", event_id LIMIT 20',
    ),
    "drop_transient_P1": (
        lambda spark, sf_dir: narrow(drop_transient(sensor_samples(spark, sf_dir))),
        sql.steps() + "SELECT subject, event_id, activityID, heart_rate FROM samples WHERE activityID <> 0",
    ),
    "transient_rows_P2": (
        lambda spark, sf_dir: narrow(transient_rows(sensor_samples(spark, sf_dir))),
        sql.steps() + "SELECT subject, event_id, activityID, heart_rate FROM samples WHERE activityID = 0",
    ),
    "drop_orientation_P3": (
        lambda spark, sf_dir: drop_columns_like(sensor_samples(spark, sf_dir)),
        sql.steps() + f"SELECT {sql.listed(sql.KEPT)} FROM samples",
    ),
    "missing_to_null_P4": (nulled_samples, sql.steps() + "SELECT * FROM nulled"),
    "missing_texts_to_null_P4": (
        nulled_texts,
        "SELECT event_id, CASE WHEN event_id % 5 NOT IN (0, 1, 2) THEN event_type END AS event_type FROM events",
    ),
    "drop_incomplete_P5": (
        lambda spark, sf_dir: drop_incomplete(label_and_fill(clean(sensor_samples(spark, sf_dir)), TIEBREAK)),
        sql.steps() + "SELECT * FROM complete",
    ),
    "residual_P6": (
        residual,
        sql.steps()
        + f"SELECT subject, event_id, heart_rate - resting_hr AS heart_rate_minus_rest FROM nulled JOIN {sql.RESTING} USING (subject)",
    ),
    "residual_from_table_P6": (
        residual_from_table,
        """SELECT l_suppkey AS subject, l_orderkey, l_linenumber, l_partkey, round(l_quantity - s_acctbal, 6) AS minus_balance
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""",
    ),
    "mean_temperature_P7": (
        average_temperature,
        sql.steps()
        + f"SELECT subject, event_id, round(({' + '.join(sql.TEMPERATURE_COLUMNS)}) / 3, 6) AS avg_temperature FROM cleaned",
    ),
    "named_labels_P8": (
        named_labels,
        sql.steps() + f"SELECT subject, event_id, activityID, label FROM cleaned LEFT JOIN {sql.NAMES} ON activityID = activity_id",
    ),
    "selected_features_P9": (selected_features, _features_sql()),
    "scalar_functions_F1_F6": (
        scalar_functions,
        f"""SELECT event_id, event_type IN ('click', 'view') AS member, event_type NOT IN ('click', 'view') AS not_member,
CASE WHEN event_id % 2 = 0 THEN event_id END AS even_only, round(value - 60, 6) AS minus_literal,
round((value + event_id + user_id) / 3, 6) AS mean_of_three, label AS looked_up, event_id % 7 <> 0 AS compared
FROM events LEFT JOIN {sql.NAMES} ON event_id % 30 = activity_id""",
    ),
    "row_counts_A1": (
        row_counts,
        sql.steps() + "," + sql.CLEANING + "SELECT subject, all_rows, kept_rows, complete_rows FROM counts",
    ),
    "transient_count_A2": (
        transient_count,
        sql.steps() + "SELECT subject, count(*) AS transient_rows FROM samples WHERE activityID = 0 GROUP BY 1",
    ),
    "class_distribution_A3": (
        distribution,
        sql.steps() + "SELECT subject, label, count(*) AS count FROM labelled GROUP BY ALL",
    ),
    "cleaning_report_A18": (
        audit_report,
        sql.steps() + "," + sql.CLEANING + sql.long_form("counts", "subject", sql.CLEANING_MEASURES, None),
    ),
    "forward_fill_W1": (filled_heart_rate, sql.steps() + "SELECT subject, event_id, heart_rate FROM filled"),
    "supplier_forward_fill_W1": (supplier_fill, _fill_sql("l_suppkey")),
    "long_series_forward_fill_W1": (long_series_fill, _fill_sql("l_linestatus")),
    "prepared_samples_J1": (prepared_samples, sql.steps() + "SELECT * FROM prepared"),
}
