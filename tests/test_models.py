"""Splits, forests, tuning and whole runs."""

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from sensorflow.catalog.models import KEY, prepared_series
from sensorflow.catalog.samples import FOUR, TWO_SUBJECTS, sample_lines, sensor_samples, table
from sensorflow.operators.evaluate import confusion
from sensorflow.operators.labels import label_index
from sensorflow.operators.split import hash_split, random_split, with_fold, with_group_fold
from sensorflow.plans.forest import (
    best_parameters,
    feature_importances,
    forest,
    grid_scores,
    train,
    tune,
    tuning_grid,
)
from sensorflow.plans.run import run, run_files
from sensorflow.sources.storage import compilable


@pytest.fixture(scope="module")
def series(spark, sf_dir):
    return prepared_series(spark, sf_dir)


@pytest.fixture(scope="module")
def trained(series):
    rows, columns = series
    return train(rows, columns, KEY)


def test_hash_split_does_not_depend_on_the_partitioning(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    training, held_out = hash_split(events, KEY)
    again, _ = hash_split(events.repartition(7), KEY)
    assert training.count() + held_out.count() == events.count()
    assert {r.event_id for r in training.collect()} == {r.event_id for r in again.collect()}
    assert 0.75 < training.count() / events.count() < 0.85


def test_random_split_is_a_partition(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    training, held_out = random_split(events)
    assert training.union(held_out).exceptAll(events).count() == 0
    assert training.count() == random_split(events)[0].count()


def test_folds_of_a_subject_key_keep_subjects_together(spark, sf_dir):
    folds = with_fold(table(spark, sf_dir, "events"), ["user_id"]).groupBy("user_id").agg(F.count_distinct("fold").alias("n"))
    assert folds.filter("n > 1").count() == 0


def test_label_index_equals_the_string_indexer(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("subject", F.lit("a")).withColumnRenamed("event_type", "label")
    labels = StringIndexer(inputCol="label", outputCol="i").fit(events).labels
    assert [r.label for r in label_index(events).orderBy("indexed_label").collect()] == list(labels)


def test_forest_settings():
    assert (forest().getNumTrees(), forest().getMaxDepth(), forest().getMinInfoGain(), forest().getSeed()) == (100, 5, 0.01, 42)
    assert (forest().getMaxBins(), forest().getImpurity(), forest().getFeatureSubsetStrategy()) == (32, "gini", "auto")


def test_held_out_rows_are_scored_whole(series, trained):
    rows, _ = series
    model, scored = trained
    assert scored.count() == hash_split(rows, KEY)[1].count()
    assert len(model.stages) == 4
    assert {r[0] for r in scored.select("predicted_label").distinct().collect()} <= set(model.stages[0].labels)
    assert confusion(scored).agg(F.sum("count")).first()[0] == scored.count()


def test_same_seed_same_predictions(series, trained):
    rows, columns = series
    again = train(rows, columns, KEY)[1].select("event_id", "probability").collect()
    assert sorted(again) == sorted(trained[1].select("event_id", "probability").collect())


def test_training_rows_are_laid_out_once(spark, series):
    """Passes of the forest do not shuffle and sort the training rows again."""
    rows, columns = series
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        seen.add(1)
        return value

    train(rows.withColumn(columns[0], counted(columns[0])), columns, KEY, trees=3)
    assert 0 < seen.value <= rows.count()


def test_prepared_rows_are_written_with_code_that_is_compiled(spark, series):
    limit = "spark.sql.codegen.hugeMethodLimit"
    with compilable(spark):
        assert spark.conf.get(limit) == "8000"
    assert spark.conf.get(limit) == "65535"
    spark.conf.set(limit, "9000")
    with compilable(spark):
        assert spark.conf.get(limit) == "9000"
    spark.conf.unset(limit)


def test_importances_sum_to_one_and_find_the_acceleration(spark, trained):
    values = {r.feature: r.value for r in feature_importances(spark, {"a": trained[0]}).collect()}
    assert len(values) == 42
    assert sum(values.values()) == pytest.approx(1.0)
    assert sum(v for name, v in values.items() if "3Dacc" in name) > 0.9


def test_full_grid_has_24_points():
    points = tuning_grid(forest())
    assert len(points) == 24
    assert all(len(point) == 3 for point in points)


def test_tuning_picks_the_best_point(spark, series):
    rows, columns = series
    tuned = tune(rows, columns, KEY, folds=3, depths=(0, 5), gains=(0.01,), trees=(5,))
    scores = {r.max_depth: r.accuracy for r in grid_scores(spark, tuned).collect()}
    assert scores[5] > scores[0]
    assert tuple(best_parameters(spark, tuned).first()) == (5, 0.01, 5)
    assert tuned.model.transform(rows).count() == rows.count()


@pytest.mark.parametrize("mode, settings", [("baseline", {"trees": 20}), ("tuned", {"folds": 2, "depths": (5,), "gains": (0.01,), "trees": (10,)})])
def test_run_reports_every_subject(spark, sf_dir, mode, settings):
    result = run(sensor_samples(spark, sf_dir, TWO_SUBJECTS, FOUR), KEY, mode=mode, rows_per_task=100, **settings)
    assert set(result.models) == {"subject107", "subject108"} and len(result.models) == 2
    assert result.skipped.count() == 0
    assert result.best_parameters().count() == (2 if mode == "tuned" else 0)
    assert result.score_all("subject107").count() == result.prepared.filter("subject = 'subject107'").count()
    assert result.report("Per_Subject").count() == 2 * 6
    assert result.report("Cleaning").count() == 2 * 3
    assert result.report().count() == 2 * 4 * 3
    assert result.importances.groupBy("subject").agg(F.sum("value").alias("v")).filter("abs(v - 1) > 1e-9").count() == 0


def test_run_over_text_files(spark, sf_dir, tmp_path):
    samples = sensor_samples(spark, sf_dir, TWO_SUBJECTS, FOUR)
    for subject in ("subject107", "subject108"):
        lines = sample_lines(samples.filter(F.col("subject") == subject).orderBy("event_id")).collect()
        (tmp_path / f"{subject}.dat").write_text("".join(row.value + "\n" for row in lines))
    result = run_files(spark, str(tmp_path), trees=10)
    from_table = run(samples, KEY, trees=10)
    cleaning = result.report("Cleaning").orderBy("subject", "measure").collect()
    assert cleaning == from_table.report("Cleaning").orderBy("subject", "measure").collect()
    accuracy = result.report("Per_Subject").filter("measure = 'Accuracy'").collect()
    assert [row.value for row in accuracy] == [1.0, 1.0]


def test_run_with_a_one_activity_subject(spark, sf_dir):
    only_jumping = "CAST(CASE WHEN event_id % 7 = 0 THEN 0 WHEN user_id % 2 = 0 THEN 24 ELSE 1 + event_id % 4 END AS INT)"
    result = run(sensor_samples(spark, sf_dir, TWO_SUBJECTS, only_jumping), KEY, trees=5)
    values = {r.measure: r.value for r in result.report("Per_Subject").filter("subject = 'subject107'").collect()}
    assert values["Accuracy"] == 1.0 and values["False_Pos_Rate"] is None


def test_run_refuses_unknown_modes_and_subjects(spark, sf_dir):
    samples = sensor_samples(spark, sf_dir, "'stranger'", FOUR)
    with pytest.raises(ValueError, match="unknown mode"):
        run(samples, KEY, mode="best")
    with pytest.raises(KeyError, match="stranger"):
        run(samples, KEY)


def test_forests_and_scores_do_not_depend_on_files_and_partitions(spark, series, tmp_path):
    """Labels that the features hardly show, so that another bag of rows would show in the predictions."""
    rows, columns = series
    weak = [name for name in columns if "3Dacc" not in name]
    found = []
    for parts in (1, 7):
        path = f"{tmp_path}/{parts}"
        rows.repartition(parts, F.rand(parts)).write.parquet(path)
        again = spark.read.parquet(path)
        model, scored = train(again, weak, KEY, trees=10)
        tuned = tune(hash_split(again, KEY)[0], weak, KEY, folds=2, depths=(5,), gains=(0.001,), trees=(5,))
        found.append((sorted(map(tuple, scored.select("event_id", "prediction").collect())), tuned.scores))
    assert found[0] == found[1]


def test_no_group_fold_is_empty(spark):
    rows = spark.range(90).select(F.concat(F.lit("subject10"), F.col("id") % 9).alias("subject"))
    folds = with_group_fold(rows, ["subject"], 5).groupBy("fold").agg(F.count_distinct("subject").alias("n")).collect()
    assert sorted((r.fold, r.n) for r in folds) == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 1)]


def test_folds_are_balanced_with_a_subject_of_half_the_rows(spark):
    rows = spark.range(1000).selectExpr("CASE WHEN id < 500 THEN 'hot' ELSE 's' || CAST(id % 18 AS STRING) END AS subject", "id")
    folded = with_group_fold(rows, ["subject"], 5)
    assert folded.count() == 1000 and folded.columns == ["subject", "id", "fold"]
    folds = folded.groupBy("fold").agg(F.count_distinct("subject").alias("n"), F.count("*").alias("rows")).collect()
    assert sorted((r.n for r in folds if r.rows < 500)) == [4, 4, 5, 5] and len(folds) == 5
    assert folded.groupBy("subject").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


def test_very_many_groups_fill_up_the_folds(spark):
    """Groups too small to be dealt one by one; null is a group."""
    rows = spark.range(60_000).selectExpr("CASE WHEN id < 20000 THEN 'hot' WHEN id < 20100 THEN NULL ELSE CAST(id % 7000 AS STRING) END AS subject")
    folded = with_group_fold(rows, ["subject"], 5).cache()
    sizes = sorted(r["count"] for r in folded.groupBy("fold").count().collect())
    assert sum(sizes) == 60_000 and sizes[-1] == 20_000 and sizes[3] - sizes[0] <= 120
    assert folded.groupBy("subject").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


def test_an_interrupted_run_is_continued(spark, sf_dir, tmp_path):
    """A stage without its marker, files of a write that stopped, and a batch without ledger rows are done again."""
    samples = sensor_samples(spark, sf_dir, TWO_SUBJECTS, FOUR)
    folder = tmp_path / "run"
    whole = run(samples, KEY, folder=f"{tmp_path}/whole", trees=5)
    part = f"{folder}/prepared"
    whole.prepared.limit(50).write.partitionBy("subject").parquet(part)
    (folder / "prepared" / "_SUCCESS").unlink()
    (folder / "prepared" / "_temporary").mkdir()
    (folder / "cleaning" / "_temporary").mkdir(parents=True)
    whole.predictions.limit(3).write.parquet(f"{folder}/predictions/run_batch=1")
    result = run(samples, KEY, folder=str(folder), trees=5, subjects_per_batch=1)
    assert result.prepared.count() == whole.prepared.count()
    found, wanted = (sorted(map(tuple, r.predictions.select("subject", "event_id", "prediction").collect())) for r in (result, whole))
    assert found == wanted
    assert result.cleaning.exceptAll(whole.cleaning).isEmpty()
    # A ledger without the last batch: only that subject is trained again.
    lost = next((folder / "ledger" / "run_batch=2").glob("*.parquet"))
    kept = {p: p.stat().st_mtime_ns for p in (folder / "predictions" / "run_batch=1").glob("*.parquet")}
    lost.rename(tmp_path / "lost.parquet")
    again = run(samples, KEY, folder=str(folder), trees=5)
    assert sorted(map(tuple, again.predictions.select("subject", "event_id", "prediction").collect())) == wanted
    assert {p: p.stat().st_mtime_ns for p in (folder / "predictions" / "run_batch=1").glob("*.parquet")} == kept
    # A marker that tells another number of rows than the table has.
    next((folder / "prepared").glob("subject=*/*.parquet")).rename(tmp_path / "part.parquet")
    assert run(samples, KEY, folder=str(folder), trees=5).prepared.count() == whole.prepared.count()


def test_a_run_reports_subjects_it_cannot_train_and_goes_on_where_it_stopped(spark, sf_dir, tmp_path):
    """One subject has a single complete row, which the split holds out."""
    samples = sensor_samples(spark, sf_dir, TWO_SUBJECTS, FOUR)
    lone = hash_split(prepared_series(spark, sf_dir, "'subject101'")[0], ["subject", *KEY])[1].select("event_id").first()[0]
    samples = samples.withColumn("subject", F.when(F.col("event_id") == lone, "subject101").otherwise(F.col("subject")))
    samples = samples.withColumn("heart_rate", F.when(F.col("event_id") == lone, 70.0).otherwise(F.col("heart_rate")))
    folder = str(tmp_path / "run")
    result = run(samples, KEY, folder=folder, trees=5)
    assert [tuple(r) for r in result.skipped.collect()] == [("subject101", "no training rows")]
    assert set(result.models) == {"subject107", "subject108"}
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "run").rglob("*.parquet")}
    again = run(samples, KEY, folder=folder, trees=5)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "run").rglob("*.parquet")} == times
    assert again.predictions.count() == result.predictions.count() > 0
