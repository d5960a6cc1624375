"""Metrics against Spark's own evaluators, and the edge classes."""

import random

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator

from sensorflow.operators.evaluate import (
    class_metrics,
    class_report,
    confusion,
    prediction_pairs,
    subject_metrics,
    subject_report,
)
from sensorflow.operators.labels import label_index, with_label_index
from sensorflow.operators.report import select_report

SCHEMA = "subject string, label string, predicted_label string"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    # `never_true` is only predicted, `never_predicted` is only true.
    return [
        ("a", draw.choice(["x", "x", "y", "z", "never_predicted"]), draw.choice(["x", "y", "z", "z", "never_true"]))
        for _ in range(500)
    ]


def test_metrics_equal_the_evaluator(spark, rows):
    predictions = spark.createDataFrame(rows, SCHEMA)
    names = sorted({label for row in rows for label in row[1:]})
    number = {name: float(i) for i, name in enumerate(names)}
    pairs = spark.createDataFrame([(number[p], number[t]) for _, t, p in rows], "prediction double, label double")

    def evaluated(metric, **params):
        return MulticlassClassificationEvaluator(metricName=metric, **params).evaluate(pairs)

    per_class = class_metrics(confusion(predictions))
    for row in per_class.collect():
        at = number[row["class"]]
        assert row.precision == pytest.approx(evaluated("precisionByLabel", metricLabel=at))
        assert row.recall == pytest.approx(evaluated("recallByLabel", metricLabel=at))
        assert row.f1 == pytest.approx(evaluated("fMeasureByLabel", metricLabel=at))
        assert row.f0_5 == pytest.approx(evaluated("fMeasureByLabel", metricLabel=at, beta=0.5))
        assert row.false_positive_rate == pytest.approx(evaluated("falsePositiveRateByLabel", metricLabel=at))
    whole = subject_metrics(per_class).first()
    assert whole.accuracy == pytest.approx(evaluated("accuracy"))
    assert whole.test_error == pytest.approx(1 - evaluated("accuracy"))
    assert whole.micro_precision == whole.micro_recall == whole.micro_f1 == whole.accuracy
    assert whole.weighted_recall == pytest.approx(evaluated("weightedRecall"))
    assert whole.weighted_precision == pytest.approx(evaluated("weightedPrecision"))
    assert whole.weighted_f1 == pytest.approx(evaluated("weightedFMeasure"))
    assert whole.weighted_f0_5 == pytest.approx(evaluated("weightedFMeasure", beta=0.5))
    assert whole.weighted_false_positive_rate == pytest.approx(evaluated("weightedFalsePositiveRate"))


def test_edge_classes(spark, rows):
    per_class = {r["class"]: r for r in class_metrics(confusion(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert "never_true" not in per_class
    assert per_class["never_predicted"].precision == 0.0 and per_class["never_predicted"].f1 == 0.0
    assert sum(r.rows for r in per_class.values()) == 500


def test_one_true_class_has_no_false_positive_rate(spark):
    only = spark.createDataFrame([("a", "x", "x"), ("a", "x", "y")], SCHEMA)
    whole = subject_metrics(class_metrics(confusion(only))).first()
    assert whole.accuracy == 0.5
    assert whole.weighted_false_positive_rate is None


def test_subjects_do_not_mix(spark):
    both = spark.createDataFrame([("a", "x", "x"), ("b", "x", "y"), ("b", "y", "y")], SCHEMA)
    accuracy = {r.subject: r.accuracy for r in subject_metrics(class_metrics(confusion(both))).collect()}
    assert accuracy == {"a": 1.0, "b": 0.5}


def test_report_rows(spark, rows):
    per_class = class_metrics(confusion(spark.createDataFrame(rows, SCHEMA)))
    assert class_report(per_class).count() == 4 * 3
    measures = {r.measure for r in subject_report(subject_metrics(per_class)).collect()}
    assert measures == {"Accuracy", "Recall", "precision", "F1_Score", "F0_5_Score", "False_Pos_Rate"}
    with pytest.raises(ValueError, match="unknown report"):
        select_report({}, "per class")


def test_equal_counts_are_indexed_alphabetically(spark):
    df = spark.createDataFrame([("a", name, None) for name in ["b", "a", "c", "c", None]], SCHEMA)
    index = label_index(df)
    assert {r.label: r.indexed_label for r in index.collect()} == {"c": 0.0, "a": 1.0, "b": 2.0}
    indexed = with_label_index(with_label_index(df, index), index, "predicted_label", "prediction")
    assert prediction_pairs(indexed).columns == ["prediction", "indexed_label"]
    assert indexed.count() == 5
