"""Forests of a grid out of one fit."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sensorflow.plans.forest import FEATURES, GRID_DEPTHS, GRID_GAINS, tune, tuning_grid
from sensorflow.plans.nested import count_hits, nested_forests
from sensorflow.schema import INDEXED_LABEL, LABEL


@pytest.fixture(scope="module")
def weak(spark):
    """Three classes that four columns show only in part."""
    rows = spark.range(3000).selectExpr("id", "CAST(id % 3 AS DOUBLE) AS indexed_label", "id % 3 + 2 * rand(1) AS a", "rand(2) AS b",
                                        "IF(id % 3 = 1, 0.3, 0) + rand(3) AS c", "IF(id % 7 = 1, id % 3, 0) + rand(4) AS d")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol=FEATURES).transform(rows).coalesce(1).cache()


def test_cut_trees_are_those_of_forests_grown_so(weak, tmp_path):
    """With all features at every node nothing but the bags is drawn, and those depend on the number of trees alone."""
    estimator = RandomForestClassifier(labelCol=INDEXED_LABEL, featuresCol=FEATURES, seed=7, featureSubsetStrategy="all")
    points = tuning_grid(estimator, (0, 1, 3, 5), (0.1, 0.01, 0.001), (4,))
    training, others = weak.filter("id % 5 <> 0"), weak.filter("id % 5 = 0")
    found = count_hits(nested_forests(estimator, points, training, f"file://{tmp_path}"), others)
    wanted = [estimator.fit(training, point).transform(others).filter("prediction = indexed_label").count() for point in points]
    assert [found[place] for place in range(len(points))] == wanted
    assert len(set(wanted)) > 4


def test_fewer_trees_are_the_first_ones(weak, tmp_path):
    estimator = RandomForestClassifier(labelCol=INDEXED_LABEL, featuresCol=FEATURES, seed=7)
    points = tuning_grid(estimator, (4,), (0.0,), (1, 2, 5))
    forests = nested_forests(estimator, points, weak, f"file://{tmp_path}")
    assert sorted(forest.model.getNumTrees for forest in forests) == [1, 5]
    large = next(forest.model for forest in forests if forest.model.getNumTrees == 5)
    rows = weak.select(INDEXED_LABEL, FEATURES).collect()
    votes = [[tree.predictProbability(row[1]).toArray() for tree in large.trees] for row in rows[:200]]
    few = count_hits(forests, weak.sparkSession.createDataFrame(rows[:200], weak.select(INDEXED_LABEL, FEATURES).schema))
    lone = next(forest.model for forest in forests if forest.model.getNumTrees == 1)
    assert few[0] == sum(lone.predict(row[1]) == row[0] for row in rows[:200])
    for place, trees in ((1, 2), (2, 5)):
        assert few[place] == sum(np.sum(vote[:trees], axis=0).argmax() == row[0] for vote, row in zip(votes, rows))


def test_a_grid_search_fits_one_forest_a_fold_and_the_best(spark, weak, monkeypatch):
    fits, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: fits.append(self.getNumTrees()) or fit(self, df))
    rows = weak.select("id", "a", "b", "c", "d", F.concat(F.lit("l"), F.col(INDEXED_LABEL).cast("int")).alias(LABEL))
    tuned = tune(rows, ["a", "b", "c", "d"], ["id"], folds=3, trees=(2, 6))
    assert len(fits) == 4 and fits.count(6) >= 3
    assert len(tuned.scores) == len(GRID_DEPTHS) * len(GRID_GAINS) * 2
    best = max(tuned.scores, key=lambda row: row[-1])
    assert (tuned.model.stages[2].getMaxDepth(), tuned.model.stages[2].getNumTrees) == (best[0], best[2])


def test_a_grid_search_assembles_features_once(spark, weak, monkeypatch):
    """What fits and scoring read is stored with its features: no row function above the stored table."""
    plans, fit = [], RandomForestClassifier._fit

    def seen(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return fit(self, df)

    monkeypatch.setattr(RandomForestClassifier, "_fit", seen)
    rows = weak.select("id", "a", "b", "c", "d", F.concat(F.lit("l"), F.col(INDEXED_LABEL).cast("int")).alias(LABEL))
    tune(rows, ["a", "b", "c", "d"], ["id"], folds=2, depths=(2,), gains=(0.01,), trees=(2,))
    assert len(plans) == 3
    for text in plans:
        above, _, stored = text.partition("InMemoryRelation")
        assert "UDF(" not in above and "features" in stored.partition("]")[0]


def test_hits_do_not_depend_on_batches(spark, weak, tmp_path):
    estimator = RandomForestClassifier(labelCol=INDEXED_LABEL, featuresCol=FEATURES, seed=7)
    points = tuning_grid(estimator, (0, 2, 4), (0.01, 0.0), (2, 5))
    forests = nested_forests(estimator, points, weak, f"file://{tmp_path}")
    whole = count_hits(forests, weak)
    assert sum(whole.values()) > 0 and count_hits(forests, weak.filter("id < 0")) == dict.fromkeys(whole, 0)
    parts = [count_hits(forests, weak.repartition(5).filter(f"id % 3 = {k}")) for k in range(3)]
    assert {place: sum(part[place] for part in parts) for place in whole} == whole


def test_a_fold_without_rows_is_an_error(weak):
    rows = weak.select("id", "a", F.lit("x").alias(LABEL), (F.col("id") % 2).cast("int").alias("fold"))
    with pytest.raises(ValueError, match="every fold"):
        tune(rows, ["a"], ["id"], folds=3, fold_column="fold", depths=(1,), gains=(0.0,), trees=(2,))
