"""Queries on splits, forests, tuning and whole runs.

The samples of these queries carry four activities that the acceleration columns
tell apart, so a forest that works predicts every row's activity and the
checking SQL can state the expected label of each row.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorflow.catalog import check_sql as sql
from sensorflow.catalog.samples import FOUR, NINE_SUBJECTS, TWO_SUBJECTS, UNEQUAL, sensor_samples, table
from sensorflow.operators.clean import preview
from sensorflow.operators.derive import feature_columns
from sensorflow.operators.split import hash_split, random_split, with_fold, with_group_fold
from sensorflow.plans.forest import (
    FOLDS,
    GRID_DEPTHS,
    GRID_GAINS,
    GRID_TREES,
    TunedForest,
    assemble,
    best_parameters,
    by_importance,
    feature_elements,
    feature_importances,
    forest,
    grid_scores,
    train,
    tune,
    tuning_grid,
    without_features,
)
from sensorflow.plans.prepare import prepare
from sensorflow.plans.run import RunResult, run
from sensorflow.sources.storage import shared_folder, write_by_subject

ONE_SUBJECT = "'subject108'"
KEY = ["event_id"]
NOT_FEATURES = ["subject", "event_id"]
ONE_COLUMN = {"subject107": "IMU_hand_3Dacc_2", "subject108": "IMU_chest_3Dacc_2"}


def prepared_series(spark, sf_dir, subject=ONE_SUBJECT, activity=FOUR) -> tuple[DataFrame, list[str]]:
    """All events as prepared rows, of one subject unless told otherwise, stored, and their feature columns."""
    samples = sensor_samples(spark, sf_dir, subject, activity)
    rows = write_by_subject(prepare(samples, KEY), shared_folder(spark, "prepared"))
    return rows, feature_columns(rows, NOT_FEATURES)


def split_rows(spark, sf_dir):
    training, held_out = hash_split(table(spark, sf_dir, "events").select("event_id"), KEY)
    return training.withColumn("part", F.lit("training")).union(held_out.withColumn("part", F.lit("held out")))


def random_split_rows(spark, sf_dir):
    """Rows of the random split, rows that both parts hold, and whether about 80 % are in the training part."""
    training, held_out = random_split(table(spark, sf_dir, "events").select("event_id"))
    both = training.withColumn("trained", F.lit(1)).union(held_out.withColumn("trained", F.lit(0)))
    rows = both.groupBy("event_id").agg(F.count("*").alias("parts"), F.sum("trained").alias("trained"))
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("parts") > 1).alias("in_both"),
        (F.sum("trained") / F.count("*")).between(0.7, 0.9).alias("share_in_band"),
    )


def assembled_features(spark, sf_dir):
    prepared = prepare(sensor_samples(spark, sf_dir), KEY)
    assembled = assemble(feature_columns(prepared, NOT_FEATURES)).transform(prepared)
    return feature_elements(assembled, KEY).select("event_id", "position", F.round("value", 6).alias("value"))


def trained(spark, sf_dir) -> tuple[PipelineModel, DataFrame, DataFrame, list[str]]:
    rows, columns = prepared_series(spark, sf_dir)
    model, scored = train(rows, columns, KEY)
    return model, scored, rows, columns


def held_out_predictions(spark, sf_dir):
    scored = trained(spark, sf_dir)[1]
    return scored.select("event_id", "label", "indexed_label", "prediction", "predicted_label")


def label_conversion(spark, sf_dir):
    """Which label each predicted index becomes, with its rows."""
    scored = trained(spark, sf_dir)[1]
    return scored.groupBy("prediction", "predicted_label").agg(F.count("*").alias("rows"))


def stored_model_predictions(spark, sf_dir):
    """The four-stage model saved, loaded again and applied to all rows."""
    model, _, rows, _ = trained(spark, sf_dir)
    path = shared_folder(spark, "model")
    model.save(path)
    return PipelineModel.load(path).transform(rows).select("event_id", "label", "predicted_label")


def importances(spark, sf_dir):
    """Importances per subject where one column, another one for each subject, tells the activities and all others are constant."""
    rows, columns = prepared_series(spark, sf_dir, TWO_SUBJECTS)
    models = {}
    for subject, informative in ONE_COLUMN.items():
        constant = {name: F.lit(1.0) for name in columns if name != informative}
        models[subject] = train(rows.filter(F.col("subject") == subject).withColumns(constant), columns, KEY)[0]
    ranked = by_importance(feature_importances(spark, models))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("value"), "feature")))


def prediction_preview(spark, sf_dir):
    _, scored, _, columns = trained(spark, sf_dir)
    view = without_features(scored, columns)
    plain = [name for name, kind in view.dtypes if kind != "vector"]
    return preview(view, plain, ["timestamp", "event_id"], rows=5)


def line_predictions(spark, sf_dir):
    """Discount bands learned from all lines: rows per true and predicted band of held-out lines."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "rebate"]
    rebate = (F.col("l_discount") * F.col("l_extendedprice")).alias("rebate")
    lines = table(spark, sf_dir, "lineitem").select("*", rebate).select(*LINE_KEY, F.expr(LINE_BAND).alias("label"), *columns)
    path = shared_folder(spark, "lines")
    lines.write.parquet(path)
    scored = train(spark.read.parquet(path), columns, LINE_KEY)[1]
    return scored.groupBy("label", "predicted_label").agg(F.count("*").alias("rows"))


LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_BAND = "CASE WHEN l_discount < 0.035 THEN 'low' WHEN l_discount < 0.075 THEN 'middle' ELSE 'high' END"


def grid_folds(spark, sf_dir):
    """Rows each grid point of the cross-validation query trains on and validates with, per fold."""
    points = tuning_grid(forest())
    settings = [{param.name: value for param, value in point.items()} for point in points]
    grid = F.array(
        *[
            F.struct(
                F.lit(point["maxDepth"]).alias("max_depth"),
                F.lit(point["minInfoGain"]).alias("min_info_gain"),
                F.lit(point["numTrees"]).alias("num_trees"),
            )
            for point in settings
        ]
    )
    training, _ = hash_split(prepared_series(spark, sf_dir, activity=UNEQUAL)[0], KEY)
    sizes = with_fold(training, KEY, FOLDS).groupBy("fold").agg(F.count("*").alias("validation_rows"))
    whole = sizes.agg(F.sum("validation_rows").alias("total"), F.collect_list(F.struct("fold", "validation_rows")).alias("folds"))
    per_fold = whole.select("total", F.inline("folds")).withColumn("training_rows", F.col("total") - F.col("validation_rows"))
    return per_fold.select("fold", "training_rows", "validation_rows", F.inline(grid))


def tuned_series(spark, sf_dir) -> tuple[TunedForest, DataFrame]:
    """The full grid over two activities of unequal share that the acceleration tells apart."""
    rows, columns = prepared_series(spark, sf_dir, activity=UNEQUAL)
    training, _ = hash_split(rows, KEY)
    return tune(training, columns, KEY), rows


def rounded_scores(spark, tuned: TunedForest) -> DataFrame:
    return grid_scores(spark, tuned).withColumn("accuracy", F.round("accuracy", sql.DIGITS))


def cross_validation_scores(spark, sf_dir):
    """Mean accuracy of all 24 grid points over 5 folds."""
    return rounded_scores(spark, tuned_series(spark, sf_dir)[0])


def chosen_parameters(spark, sf_dir):
    return best_parameters(spark, tuned_series(spark, sf_dir)[0])


def grouped_fold_scores(spark, sf_dir):
    """The full grid over folds that keep the events of a subject together."""
    rows, columns = prepared_series(spark, sf_dir, NINE_SUBJECTS, UNEQUAL)
    folded = with_group_fold(rows, ["subject"], FOLDS)
    return rounded_scores(spark, tune(folded, columns, KEY, folds=FOLDS, fold_column="fold"))


def tuned_predictions(spark, sf_dir):
    """All rows, training rows included, scored by the best model."""
    tuned, rows = tuned_series(spark, sf_dir)
    return tuned.model.transform(rows).select("event_id", "label", "predicted_label")


def baseline_run(spark, sf_dir) -> RunResult:
    return run(sensor_samples(spark, sf_dir, NINE_SUBJECTS, FOUR), KEY)


def run_report(spark, sf_dir):
    report = baseline_run(spark, sf_dir).report("Per_Subject")
    return report.select("subject", "measure", F.round("value", sql.DIGITS).alias("value"))


def tuned_run_report(spark, sf_dir):
    samples = sensor_samples(spark, sf_dir, TWO_SUBJECTS, FOUR)
    result = run(samples, KEY, mode="tuned")
    report = result.report("Per_class")
    return report.select("subject", "class", "measure", F.round("value", sql.DIGITS).alias("value"))


def _series(subject: str = ONE_SUBJECT, activity: str = FOUR) -> str:
    held_out = f"{sql.row_hash('CAST(event_id AS VARCHAR)')} % 100 >= 80"
    return (
        sql.steps(subject, activity)
        + f""", label_indices AS ({sql.index_sql('prepared')}),
indexed AS (SELECT prepared.*, indexed_label FROM prepared JOIN label_indices USING (subject, label)),
held_out AS (SELECT event_id, "timestamp", activityID, subject, label, indexed_label, indexed_label AS prediction,
  label AS predicted_label FROM indexed WHERE {held_out})
"""
    )


def _run_sql(subject: str) -> str:
    key = "subject || '|' || CAST(event_id AS VARCHAR)"
    return (
        sql.steps(subject, FOUR)
        + f", predictions AS (SELECT subject, label, label AS predicted_label FROM prepared WHERE {sql.row_hash(key)} % 100 >= 80),\n"
        + sql.METRICS
    )


def _scores_sql(folded: str, subject: str = ONE_SUBJECT) -> str:
    """Scores of the grid: depth 0 guesses the largest label, deeper forests know every label."""
    return (
        sql.steps(subject, UNEQUAL)
        + f""", folded AS ({folded}),
largest AS (SELECT label FROM folded GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
guessed AS (SELECT fold, avg(CASE WHEN label = (SELECT label FROM largest) THEN 1 ELSE 0 END) AS share FROM folded GROUP BY fold),
scores AS (SELECT max_depth, CAST(min_info_gain AS DOUBLE) AS min_info_gain, num_trees,
  round(CASE WHEN max_depth = 0 THEN (SELECT avg(share) FROM guessed) ELSE 1 END, {sql.DIGITS}) AS accuracy FROM {GRID_SQL})
"""
    )


FOLD_SQL = f"CAST({sql.row_hash('CAST(event_id AS VARCHAR)')} % {FOLDS} AS INT) AS fold"
TRAINING_SQL = f"{sql.row_hash('CAST(event_id AS VARCHAR)')} % 100 < 80"
FOLDED_SQL = f"SELECT label, {FOLD_SQL} FROM prepared WHERE {TRAINING_SQL}"
# Subjects by size, each to the first fold of the fewest rows so far.
GROUPED_SQL = f"""SELECT label, fold FROM prepared JOIN (
WITH RECURSIVE ranked AS (SELECT subject, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {sql.row_hash('subject')}, subject) AS place FROM prepared GROUP BY subject),
dealt AS (
  SELECT 0::BIGINT AS place, NULL::VARCHAR AS subject, NULL::BIGINT AS fold, [{', '.join(['0::BIGINT'] * FOLDS)}] AS loads
  UNION ALL
  SELECT ranked.place, ranked.subject, list_position(loads, list_min(loads))::BIGINT - 1,
         list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + n ELSE x END)
  FROM dealt JOIN ranked ON ranked.place = dealt.place + 1)
SELECT subject, fold FROM dealt WHERE place > 0) USING (subject)"""
GRID_SQL = " CROSS JOIN ".join(
    f"({sql.values((value,) for value in axis)}) AS {name}_axis({name})"
    for name, axis in (("max_depth", GRID_DEPTHS), ("min_info_gain", GRID_GAINS), ("num_trees", GRID_TREES))
)

ENTRIES = {
    "feature_vectors_M2": (
        assembled_features,
        sql.steps()
        + f"""SELECT event_id, unnest(range({len(sql.FEATURES)}))::INT AS position,
round(unnest([{sql.listed(sql.DOUBLES_KEPT + sql.FEATURES[-2:])}]), 6) AS value FROM prepared""",
    ),
    "hash_split_M3": (
        split_rows,
        f"""SELECT event_id, CASE WHEN {sql.row_hash('CAST(event_id AS VARCHAR)')} % 100 < 80
THEN 'training' ELSE 'held out' END AS part FROM events""",
    ),
    "random_split_M3": (
        random_split_rows,
        "SELECT count(*) AS rows, 0::BIGINT AS in_both, true AS share_in_band FROM events",
    ),
    "held_out_predictions_M4_M7": (
        held_out_predictions,
        _series() + "SELECT event_id, label, indexed_label, prediction, predicted_label FROM held_out",
    ),
    "line_predictions_M4_M7": (
        line_predictions,
        f"""SELECT {LINE_BAND} AS label, {LINE_BAND} AS predicted_label, count(*) AS rows FROM lineitem
WHERE {sql.row_hash("concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)")} % 100 >= 80 GROUP BY ALL""",
    ),
    "label_conversion_M5": (
        label_conversion,
        _series() + "SELECT prediction, predicted_label, count(*) AS rows FROM held_out GROUP BY ALL",
    ),
    "stored_model_M6": (
        stored_model_predictions,
        _series() + "SELECT event_id, label, label AS predicted_label FROM prepared",
    ),
    "feature_importances_M8_O2": (
        importances,
        f"""WITH told AS (SELECT subject, feature, CASE WHEN feature = informative THEN 1e0 ELSE 0e0 END AS value
  FROM ({sql.values(ONE_COLUMN.items())}) AS s(subject, informative) CROSS JOIN ({sql.values((name,) for name in sql.FEATURES)}) AS f(feature)
  WHERE subject IN (SELECT {TWO_SUBJECTS.replace("STRING", "VARCHAR")} FROM events))
SELECT subject, feature, value, CAST(row_number() OVER (PARTITION BY subject ORDER BY value DESC, feature) AS INT) AS place FROM told""",
    ),
    "prediction_preview_P10_O3": (
        prediction_preview,
        _series() + 'SELECT * FROM held_out ORDER BY "timestamp", event_id LIMIT 5',
    ),
    "parameter_grid_M9": (
        grid_folds,
        sql.steps(ONE_SUBJECT, UNEQUAL)
        + f""", sizes AS (SELECT {FOLD_SQL}, count(*) AS validation_rows FROM prepared WHERE {TRAINING_SQL} GROUP BY 1)
SELECT fold, CAST((SELECT sum(validation_rows) FROM sizes) - validation_rows AS BIGINT) AS training_rows, validation_rows,
max_depth, CAST(min_info_gain AS DOUBLE) AS min_info_gain, num_trees FROM sizes CROSS JOIN {GRID_SQL}""",
    ),
    "cross_validation_M10": (cross_validation_scores, _scores_sql(FOLDED_SQL) + "SELECT * FROM scores"),
    "grouped_folds_M10": (grouped_fold_scores, _scores_sql(GROUPED_SQL, NINE_SUBJECTS) + "SELECT * FROM scores"),
    "best_parameters_M11": (
        chosen_parameters,
        _scores_sql(FOLDED_SQL)
        + """SELECT max_depth, min_info_gain, num_trees FROM scores
ORDER BY accuracy DESC, max_depth, min_info_gain DESC, num_trees LIMIT 1""",
    ),
    "tuned_predictions_M12": (
        tuned_predictions,
        _series(activity=UNEQUAL) + "SELECT event_id, label, label AS predicted_label FROM prepared",
    ),
    "subject_runs_J1": (
        run_report,
        _run_sql(NINE_SUBJECTS) + sql.long_form("subject_metrics", "subject", sql.SUBJECT_MEASURES),
    ),
    "tuned_run_J2": (
        tuned_run_report,
        _run_sql(TWO_SUBJECTS) + sql.long_form("class_metrics", "subject, class", sql.CLASS_MEASURES),
    ),
}
