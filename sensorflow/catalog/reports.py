"""Queries on metrics and report tables, over labels predicted by a fixed rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorflow.catalog import check_sql as sql
from sensorflow.catalog.samples import rule_predictions, sensor_samples, table
from sensorflow.operators.audit import cleaning_counts, cleaning_report
from sensorflow.operators.evaluate import (
    class_metrics,
    class_report,
    classes_in_order,
    confusion,
    index_label_table,
    prediction_pairs,
    subject_metrics,
    subject_report,
    true_classes,
)
from sensorflow.operators.labels import class_distribution, label_index, with_index_of_counts, with_label_index
from sensorflow.operators.report import append_measures, select_report

CLASS_KEYS = ["subject", "class"]


def rounded(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    return df.select(*keys, *[F.round(name, sql.DIGITS).alias(name) for name in columns])


def indexed_predictions(spark, sf_dir):
    """Rule predictions with the indices of true and predicted label."""
    predictions = rule_predictions(spark, sf_dir)
    index = label_index(predictions)
    true = with_label_index(predictions, index)
    return with_label_index(true, index, "predicted_label", "prediction")


def indexed_counts(spark, sf_dir):
    """Rows per true label with the label's index: the predictions are counted before the index is looked up."""
    counts = class_distribution(rule_predictions(spark, sf_dir).filter("label IS NOT NULL"))
    return with_index_of_counts(counts)


def per_class(spark, sf_dir):
    return class_metrics(confusion(rule_predictions(spark, sf_dir)))


def per_subject(spark, sf_dir):
    return subject_metrics(per_class(spark, sf_dir))


def class_column(name):
    return lambda spark, sf_dir: rounded(per_class(spark, sf_dir), CLASS_KEYS, name)


def subject_columns(*names):
    return lambda spark, sf_dir: rounded(per_subject(spark, sf_dir), ["subject"], *names)


def line_report(spark, sf_dir):
    """Per-subject report of lines: return flag guessed from the line status, per supplier."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "'supplier' || CAST(l_suppkey AS STRING) AS subject",
        "l_returnflag AS label",
        "CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity < 25 THEN 'A' ELSE 'R' END AS predicted_label",
    )
    return rounded(subject_report(subject_metrics(class_metrics(confusion(lines)))), ["subject", "measure"], "value")


def all_reports(spark, sf_dir):
    return {
        "Per_class": lambda: class_report(per_class(spark, sf_dir)),
        "Per_Subject": lambda: subject_report(per_subject(spark, sf_dir)),
        "Cleaning": lambda: cleaning_report(cleaning_counts(sensor_samples(spark, sf_dir), ["event_id"])),
    }


def chosen_report(kind, keys):
    return lambda spark, sf_dir: rounded(select_report(all_reports(spark, sf_dir), kind), [*keys, "measure"], "value")


def appended_measures(spark, sf_dir):
    reports = all_reports(spark, sf_dir)
    measures = append_measures(reports["Cleaning"](), reports["Per_Subject"]())
    return rounded(measures, ["subject", "measure"], "value")


def _class_sql(name: str) -> str:
    return sql.RULE_METRICS + f"SELECT subject, class, round({name}, {sql.DIGITS}) AS {name} FROM class_metrics"


def _subject_sql(*names: str) -> str:
    return sql.RULE_METRICS + f"SELECT subject, {', '.join(f'round({name}, {sql.DIGITS}) AS {name}' for name in names)} FROM subject_metrics"


INDEXED = f"""WITH predictions AS ({sql.RULE_PREDICTIONS_SQL}), label_indices AS ({sql.index_sql('predictions')}),
indexed AS (SELECT p.subject, p.event_id, p.label, p.predicted_label, t.indexed_label, q.indexed_label AS prediction
  FROM predictions p JOIN label_indices t ON p.subject = t.subject AND p.label = t.label
  LEFT JOIN label_indices q ON p.subject = q.subject AND p.predicted_label = q.label)
"""
MICRO = f"""SELECT subject, round(accuracy, {sql.DIGITS}) AS micro_precision, round(accuracy, {sql.DIGITS}) AS micro_recall,
round(accuracy, {sql.DIGITS}) AS micro_f1 FROM subject_metrics"""
CLASS_LONG = sql.long_form("class_metrics", "subject, class", sql.CLASS_MEASURES)
SUBJECT_LONG = sql.long_form("subject_metrics", "subject", sql.SUBJECT_MEASURES)
CLEANING_LONG = sql.steps() + "," + sql.CLEANING + sql.long_form("counts", "subject", sql.CLEANING_MEASURES, None)

ENTRIES = {
    "prediction_pairs_P11": (
        lambda spark, sf_dir: prediction_pairs(indexed_predictions(spark, sf_dir)),
        INDEXED + "SELECT prediction, indexed_label FROM indexed",
    ),
    "label_index_M1": (
        lambda spark, sf_dir: label_index(rule_predictions(spark, sf_dir)),
        INDEXED + "SELECT * FROM label_indices",
    ),
    "confusion_A4": (
        lambda spark, sf_dir: confusion(rule_predictions(spark, sf_dir)),
        sql.RULE_METRICS + "SELECT * FROM confusion",
    ),
    "index_labels_A5": (
        lambda spark, sf_dir: index_label_table(indexed_counts(spark, sf_dir)),
        INDEXED + "SELECT subject, indexed_label, label, count(*) AS count FROM indexed GROUP BY ALL",
    ),
    "true_classes_A6": (
        lambda spark, sf_dir: true_classes(indexed_counts(spark, sf_dir)),
        INDEXED + "SELECT DISTINCT subject, indexed_label FROM indexed",
    ),
    "accuracy_A7": (subject_columns("accuracy"), _subject_sql("accuracy")),
    "test_error_A8": (
        subject_columns("test_error"),
        sql.RULE_METRICS + f"SELECT subject, round(1 - accuracy, {sql.DIGITS}) AS test_error FROM subject_metrics",
    ),
    "micro_metrics_A9": (subject_columns("micro_precision", "micro_recall", "micro_f1"), sql.RULE_METRICS + MICRO),
    "class_precision_A10": (class_column("precision"), _class_sql("precision")),
    "class_recall_A11": (class_column("recall"), _class_sql("recall")),
    "class_f1_A12": (class_column("f1"), _class_sql("f1")),
    "weighted_recall_A13": (subject_columns("weighted_recall"), _subject_sql("weighted_recall")),
    "weighted_precision_A14": (subject_columns("weighted_precision"), _subject_sql("weighted_precision")),
    "weighted_f1_A15": (subject_columns("weighted_f1"), _subject_sql("weighted_f1")),
    "weighted_f0_5_A16": (subject_columns("weighted_f0_5"), _subject_sql("weighted_f0_5")),
    "false_positive_rate_A17": (
        subject_columns("weighted_false_positive_rate"),
        _subject_sql("weighted_false_positive_rate"),
    ),
    "class_report_A19": (
        lambda spark, sf_dir: rounded(class_report(per_class(spark, sf_dir)), [*CLASS_KEYS, "measure"], "value"),
        sql.RULE_METRICS + CLASS_LONG,
    ),
    "subject_report_A20": (
        lambda spark, sf_dir: rounded(subject_report(per_subject(spark, sf_dir)), ["subject", "measure"], "value"),
        sql.RULE_METRICS + SUBJECT_LONG,
    ),
    "line_report_A20": (
        line_report,
        f"""WITH predictions AS (SELECT 'supplier' || CAST(l_suppkey AS STRING) AS subject, l_returnflag AS label,
CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity < 25 THEN 'A' ELSE 'R' END AS predicted_label FROM lineitem),
{sql.METRICS}{SUBJECT_LONG}""",
    ),
    "classes_in_order_O1": (
        lambda spark, sf_dir: classes_in_order(index_label_table(indexed_counts(spark, sf_dir))),
        INDEXED + "SELECT subject, indexed_label, label, count(*) AS count FROM indexed GROUP BY ALL ORDER BY subject, indexed_label",
    ),
    "appended_measures_U1": (
        appended_measures,
        f"""SELECT subject, measure, CAST(value AS DOUBLE) AS value FROM ({CLEANING_LONG})
UNION ALL SELECT * FROM ({sql.RULE_METRICS}{SUBJECT_LONG})""",
    ),
    "class_report_J3": (chosen_report("Per_class", CLASS_KEYS), sql.RULE_METRICS + CLASS_LONG),
    "subject_report_J3": (chosen_report("Per_Subject", ["subject"]), sql.RULE_METRICS + SUBJECT_LONG),
    "cleaning_report_J3": (chosen_report("Cleaning", ["subject"]), CLEANING_LONG),
}
