"""Classification metrics as aggregates on a confusion table.

Only the confusion count reads predictions, pre-aggregated before its shuffle.
All metrics follow from that small table: at most one row per pair of labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorflow.operators.report import to_measures
from sensorflow.schema import INDEXED_LABEL, LABEL, PREDICTED_LABEL, SUBJECT

BY_SUBJECT = (SUBJECT,)

# Measure names of the reports.
CLASS_MEASURES = {"precision": "precision", "recall": "recall", "f1": "F1"}
SUBJECT_MEASURES = {
    "accuracy": "Accuracy",
    "weighted_recall": "Recall",
    "weighted_precision": "precision",
    "weighted_f1": "F1_Score",
    "weighted_f0_5": "F0_5_Score",
    "weighted_false_positive_rate": "False_Pos_Rate",
}


def prediction_pairs(predictions: DataFrame) -> DataFrame:
    return predictions.select("prediction", INDEXED_LABEL)


def confusion(predictions: DataFrame, by: Sequence[str] = BY_SUBJECT) -> DataFrame:
    """Rows per predicted and true label."""
    return predictions.groupBy(*by, PREDICTED_LABEL, LABEL).agg(F.count("*").alias("count"))


def index_label_table(predictions: DataFrame, by: Sequence[str] = BY_SUBJECT) -> DataFrame:
    """Which label each class index stands for, with its rows.

    Also takes rows counted before, with their number in ``count``.
    """
    rows = F.sum("count") if "count" in predictions.columns else F.count("*")
    return predictions.groupBy(*by, INDEXED_LABEL, LABEL).agg(rows.alias("count"))


def true_classes(predictions: DataFrame, by: Sequence[str] = BY_SUBJECT) -> DataFrame:
    return predictions.select(*by, INDEXED_LABEL).distinct()


def classes_in_order(classes: DataFrame, by: Sequence[str] = BY_SUBJECT) -> DataFrame:
    return classes.orderBy(*by, INDEXED_LABEL)


def f_score(precision: Column, recall: Column, beta: float) -> Column:
    """Weighted harmonic mean of precision and recall, 0 where both are 0."""
    weight = beta * beta
    return F.coalesce(F.try_divide((1 + weight) * precision * recall, weight * precision + recall), F.lit(0.0))


def class_metrics(counts: DataFrame, by: Sequence[str] = BY_SUBJECT) -> DataFrame:
    """Per true class: counts, precision, recall, F scores, false-positive rate.

    Classes that are only ever predicted get no row. The false-positive rate is
    null when a subject has one true class.
    """
    hit = F.when(F.col(PREDICTED_LABEL) == F.col(LABEL), F.col("count")).otherwise(0)
    nothing = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(LABEL).alias("class"), F.col("count").alias("rows"), nothing.alias("predicted"), hit.alias("hits")),
        F.struct(F.col(PREDICTED_LABEL).alias("class"), nothing.alias("rows"), F.col("count").alias("predicted"), nothing.alias("hits")),
    )
    per_class = (
        counts.select(*by, F.explode(sides).alias("_side"))
        .select(*by, "_side.*")
        .groupBy(*by, "class")
        .agg(F.sum("rows").alias("rows"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
        .filter("rows > 0")
        .withColumn("total", F.sum("rows").over(Window.partitionBy(*by)))
    )
    rated = per_class.withColumns(
        {
            "precision": F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)),
            "recall": F.col("hits") / F.col("rows"),
            "false_positive_rate": F.try_divide(F.col("predicted") - F.col("hits"), F.col("total") - F.col("rows")),
        }
    )
    precision, recall = F.col("precision"), F.col("recall")
    return rated.withColumns({"f1": f_score(precision, recall, 1.0), "f0_5": f_score(precision, recall, 0.5)})


def subject_metrics(per_class: DataFrame, by: Sequence[str] = BY_SUBJECT) -> DataFrame:
    """Accuracy, test error and class-weighted metrics per subject.

    Without a class, precision, recall and F1 count every row once and equal the
    accuracy; they are the columns named ``micro_*``.
    """

    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * F.col("rows") / F.col("total"))

    accuracy = F.sum("hits") / F.max("total")
    return per_class.groupBy(*by).agg(
        accuracy.alias("accuracy"),
        (1 - accuracy).alias("test_error"),
        accuracy.alias("micro_precision"),
        accuracy.alias("micro_recall"),
        accuracy.alias("micro_f1"),
        weighted("recall").alias("weighted_recall"),
        weighted("precision").alias("weighted_precision"),
        weighted("f1").alias("weighted_f1"),
        weighted("f0_5").alias("weighted_f0_5"),
        weighted("false_positive_rate").alias("weighted_false_positive_rate"),
    )


def class_report(per_class: DataFrame, by: Sequence[str] = BY_SUBJECT) -> DataFrame:
    return to_measures(per_class, [*by, "class"], CLASS_MEASURES)


def subject_report(per_subject: DataFrame, by: Sequence[str] = BY_SUBJECT) -> DataFrame:
    return to_measures(per_subject, by, SUBJECT_MEASURES)
