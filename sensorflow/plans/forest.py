"""Random-forest training, tuning and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.operators.split import hash_split, with_fold
from sensorflow.plans.nested import count_hits, nested_forests
from sensorflow.schema import FEATURES, INDEXED_LABEL, LABEL, PREDICTED_LABEL, SEED, SUBJECT
from sensorflow.sources.storage import shared_folder

# Forest settings and tuning grid.
TREES, DEPTH, MIN_GAIN = 100, 5, 0.01
GRID_DEPTHS, GRID_GAINS, GRID_TREES = (0, 1, 5), (0.01, 0.001), (5, 10, 30, 100)
FOLDS = 5

ROWS_PER_PARTITION = 20_000
ROWS_AT_ONCE = 8_000_000
FOLD = "_fold"


@dataclass(frozen=True)
class TunedForest:
    model: PipelineModel
    scores: list[tuple]  # depth, min gain, trees, mean accuracy over the folds


def index_labels(df: DataFrame) -> StringIndexerModel:
    return StringIndexer(inputCol=LABEL, outputCol=INDEXED_LABEL).fit(df)


def assemble(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=FEATURES)


def name_predictions(indexer: StringIndexerModel) -> IndexToString:
    return IndexToString(inputCol="prediction", outputCol=PREDICTED_LABEL, labels=indexer.labels)


def forest(trees: int = TREES, depth: int = DEPTH, min_gain: float = MIN_GAIN, seed: int = SEED) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=INDEXED_LABEL, featuresCol=FEATURES, numTrees=trees, maxDepth=depth, minInfoGain=min_gain, seed=seed
    )


def placed(df: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """Training rows laid out by their key and ``rows`` alone.

    A forest draws its samples by partition and place in it. Rows go to
    ``rows / ROWS_PER_PARTITION`` partitions by a hash of the key and are sorted by it, so the
    same rows and seed give the same forest on any machine and from any files.
    """
    return df.repartition(max(1, -(-rows // ROWS_PER_PARTITION)), *key).sortWithinPartitions(*key)


def train(
    prepared: DataFrame, columns: Sequence[str], key: Sequence[str], rows: int | None = None, **settings
) -> tuple[PipelineModel, DataFrame]:
    """Fit on the training part; returns the model and the scored held-out rows.

    Labels are indexed over all rows, so both parts know every label. Feed it a
    stored table: each pass of the forest reads the input. ``rows``, the number of rows of ``prepared``, is counted
    if it is not given.
    """
    indexer = index_labels(prepared)
    training, held_out = hash_split(prepared, key)
    laid = placed(training.select(*key, LABEL, *columns), key, prepared.count() if rows is None else rows)
    stages = [indexer, assemble(columns), forest(**settings), name_predictions(indexer)]
    laid.persist(StorageLevel.DISK_ONLY)  # every pass would shuffle and sort again
    try:
        model = Pipeline(stages=stages).fit(laid)
    finally:
        laid.unpersist()
    return model, model.transform(held_out)


def tuning_grid(
    estimator: RandomForestClassifier,
    depths: Sequence[int] = GRID_DEPTHS,
    gains: Sequence[float] = GRID_GAINS,
    trees: Sequence[int] = GRID_TREES,
) -> list[dict]:
    return (
        ParamGridBuilder()
        .addGrid(estimator.maxDepth, depths)
        .addGrid(estimator.minInfoGain, gains)
        .addGrid(estimator.numTrees, trees)
        .build()
    )


def tune(
    training: DataFrame,
    columns: Sequence[str],
    key: Sequence[str],
    indexer: StringIndexerModel | None = None,
    folds: int = FOLDS,
    fold_column: str = "",
    parallelism: int = 8,
    seed: int = SEED,
    **grid,
) -> TunedForest:
    """Cross-validated grid search by accuracy, best forest refitted on all of ``training``.

    Only the forest is searched: rows are indexed, assembled and laid out once. Without ``fold_column`` a hash of ``key``
    gives the fold. Per fold the forests of all grid points come out of one fit (:mod:`~sensorflow.plans.nested`), and one
    pass over the fold's rows scores them all. Folds are fitted side by side, at most ``parallelism`` and
    about ROWS_AT_ONCE rows at a time.
    """
    spark = training.sparkSession
    indexer = indexer or index_labels(training)
    assembler = assemble(columns)
    estimator = RandomForestClassifier(labelCol=INDEXED_LABEL, featuresCol=FEATURES, seed=seed)
    points = tuning_grid(estimator, **grid)
    fold = fold_column or FOLD
    folded = training if fold_column else with_fold(training, key, folds, FOLD)
    sizes = dict(folded.groupBy(fold).count().limit(folds + 1).collect())
    if set(sizes) != set(range(folds)) or folds < 2:
        raise ValueError(f"every fold from 0 to {folds - 1} needs rows, and no row may be in another one; found {sorted(sizes, key=str)}")
    total = sum(sizes.values())
    laid = placed(folded.select(*dict.fromkeys([*key, LABEL, *columns, fold])), key, total)
    # Each fit reads its rows four times: indexed and assembled before they are stored, not in every pass.
    rows = assembler.transform(indexer.transform(laid)).select(INDEXED_LABEL, FEATURES, fold).persist(StorageLevel.DISK_ONLY)
    try:

        def score(number: int) -> list[float]:
            models = nested_forests(estimator, points, rows.filter(F.col(fold) != number), shared_folder(spark, "forests"))
            hits = count_hits(models, rows.filter(F.col(fold) == number))
            return [hits[place] / sizes[number] for place in range(len(points))]

        with ThreadPoolExecutor(max(1, min(parallelism, folds, ROWS_AT_ONCE // total))) as pool:
            found = list(pool.map(inheritable_thread_target(spark)(score), range(folds)))
        averages = [sum(scores) / folds for scores in zip(*found)]
        best = estimator.fit(rows, points[max(range(len(points)), key=averages.__getitem__)])
    finally:
        rows.unpersist()
    model = PipelineModel([indexer, assembler, best, name_predictions(indexer)])
    settings = [estimator.maxDepth, estimator.minInfoGain, estimator.numTrees]
    scores = [(*[point[p] for p in settings], score) for point, score in zip(points, averages)]
    return TunedForest(model, scores)


def grid_scores(spark: SparkSession, tuned: TunedForest) -> DataFrame:
    return spark.createDataFrame(tuned.scores, "max_depth int, min_info_gain double, num_trees int, accuracy double")


def best_parameters(spark: SparkSession, tuned: TunedForest) -> DataFrame:
    """The searched parameters of the first grid point with the best score."""
    best = max(tuned.scores, key=lambda row: row[-1])
    return spark.createDataFrame([best[:3]], "max_depth int, min_info_gain double, num_trees int")


def model_importances(model: PipelineModel) -> list[tuple[str, float]]:
    return [(name, float(value)) for name, value in zip(model.stages[1].getInputCols(), model.stages[2].featureImportances.toArray())]


def feature_importances(spark: SparkSession, models: Mapping[str, PipelineModel]) -> DataFrame:
    """Importance of each feature per subject, by the column names stored in the model."""
    rows = [(subject, *entry) for subject, model in models.items() for entry in model_importances(model)]
    return spark.createDataFrame(rows, f"{SUBJECT} string, feature string, value double")


def by_importance(importances: DataFrame) -> DataFrame:
    return importances.orderBy(SUBJECT, F.desc("value"), "feature")


def feature_elements(df: DataFrame, key: Sequence[str], vector: str = FEATURES) -> DataFrame:
    """One row per vector element, for looking at assembled features."""
    return df.select(*key, F.posexplode(vector_to_array(vector)).alias("position", "value"))


def without_features(predictions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of a prediction that are no single feature."""
    return predictions.drop(*columns)
