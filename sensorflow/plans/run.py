"""Whole runs: prepare all subjects at once, then one model per subject."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import islice

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sensorflow.operators.audit import cleaning_report, stored_counts
from sensorflow.operators.derive import feature_columns
from sensorflow.operators.evaluate import class_metrics, class_report, confusion, subject_metrics, subject_report
from sensorflow.operators.impute import ROWS_PER_TASK
from sensorflow.operators.report import select_report
from sensorflow.operators.split import hash_split, in_training
from sensorflow.plans.forest import index_labels, model_importances, train, tune
from sensorflow.plans.prepare import prepare
from sensorflow.schema import INDEXED_LABEL, LABEL, PREDICTED_LABEL, RESTING_HEART_RATE, SUBJECT, TIME
from sensorflow.sources.dimensions import check_subjects
from sensorflow.sources.storage import read_by_subject, read_if_any, shared_folder, stage, write_by_subject
from sensorflow.sources.text import FILE_OFFSET, LINE_ORDER, ingest_subject_files

MODES = ("baseline", "tuned")
RESULT_COLUMNS = (LABEL, INDEXED_LABEL, "prediction", PREDICTED_LABEL)
LEDGER = (
    f"{SUBJECT} string, reason string, importances array<struct<feature: string, value: double>>, "
    "scores array<struct<max_depth: int, min_info_gain: double, num_trees: int, accuracy: double>>"
)
BATCH = "run_batch"
SUBJECTS_PER_BATCH = 16


@dataclass(frozen=True)
class Outcome:
    """What the fit of one subject gave: scored held-out rows, or the reason why there are none."""

    subject: str
    reason: str | None = None
    scored: DataFrame | None = None
    importances: list | None = None
    scores: list | None = None


class StoredModels(Mapping):
    """Models by subject, each loaded from the run's folder when it is asked for."""

    def __init__(self, folder: str, finished: DataFrame):
        self.folder, self.finished = folder, finished.filter("reason IS NULL").select(SUBJECT)

    def __getitem__(self, subject: str) -> PipelineModel:
        if self.finished.filter(F.col(SUBJECT) == subject).isEmpty():
            raise KeyError(subject)
        return PipelineModel.load(subject_path(self.folder, "models", subject))

    def __iter__(self) -> Iterator[str]:
        return (row[0] for row in self.finished.orderBy(SUBJECT).toLocalIterator())

    def __len__(self) -> int:
        return self.finished.count()


@dataclass(frozen=True)
class RunResult:
    """Tables of a run, all stored: predictions of held-out rows, importances, cleaning counts, scores of the
    grid points (empty for the baseline), and subjects without a model with the reason."""

    predictions: DataFrame
    importances: DataFrame
    cleaning: DataFrame
    scores: DataFrame
    skipped: DataFrame
    models: StoredModels
    prepared: DataFrame

    def report(self, kind: str = "Per_class") -> DataFrame:
        classes = lambda: class_metrics(confusion(self.predictions))
        reports = {
            "Per_class": lambda: class_report(classes()),
            "Per_Subject": lambda: subject_report(subject_metrics(classes())),
            "Cleaning": lambda: cleaning_report(self.cleaning),
        }
        return select_report(reports, kind)

    def best_parameters(self) -> DataFrame:
        """Per subject the searched parameters of the first grid point with the best score."""
        first = F.struct(-F.col("accuracy"), "max_depth", -F.col("min_info_gain"), "num_trees")
        return self.scores.groupBy(SUBJECT).agg(F.min_by(F.struct("max_depth", "min_info_gain", "num_trees", "accuracy"), first).alias("b")).select(SUBJECT, "b.*")

    def score_all(self, subject: str) -> DataFrame:
        """All prepared rows of a subject, training rows included, scored by its model."""
        return self.models[subject].transform(self.prepared.filter(F.col(SUBJECT) == subject))


def subject_path(folder: str, kind: str, subject: str) -> str:
    return f"{folder}/{kind}/run={hashlib.md5(subject.encode()).hexdigest()}"


def run(
    samples: DataFrame,
    tiebreak: Sequence[str],
    mode: str = "baseline",
    baseline: Mapping | DataFrame = RESTING_HEART_RATE,
    folder: str | None = None,
    subjects_at_once: int = 4,
    rows_per_task: int | None = ROWS_PER_TASK,
    subjects_per_batch: int = SUBJECTS_PER_BATCH,
    **settings,
) -> RunResult:
    """Prepare, train and score every subject; ``settings`` go to the forest or the grid search.

    ``samples`` should be a stored table: it is read several times.

    Prepared rows and predictions are written once and read back, so model
    passes read Parquet and a lost executor costs no recomputation of the fill.
    Each fit is a distributed Spark ML job over one subject's directory;
    ``subjects_at_once`` of them run side by side. Both modes score held-out rows.

    Subjects are read and finished in batches, so the driver holds no list of all of them. The predictions of a batch are one table; then one row per subject
    with its other results is committed to the ledger, and a batch without such rows counts as not done. A subject that
    has no training rows or whose fit fails is in ``skipped``; the others are finished. A second call with the same
    folder and arguments goes on where the first one stopped, wherever that was.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, choose from {MODES}")
    spark = samples.sparkSession
    folder = folder or shared_folder(spark, "run")

    def prepare_all(path: str) -> DataFrame:
        check_subjects(samples, baseline)
        return write_by_subject(prepare(samples, tiebreak, baseline=baseline, rows_per_task=rows_per_task), path, mode="overwrite")

    prepared = stage(spark, folder, "prepared", prepare_all, lambda path: read_by_subject(spark, path))
    counted = lambda path: overwritten(stored_counts(samples, prepared), path)
    cleaning = stage(spark, folder, "cleaning", counted, spark.read.parquet)
    key = [SUBJECT, *tiebreak]
    columns = feature_columns(prepared, key)

    def fit(counted: Row) -> Outcome:
        subject = counted[SUBJECT]
        if not counted.training_rows:
            return Outcome(subject, "no training rows")
        try:
            model, scored, scores = fitted(prepared.filter(F.col(SUBJECT) == subject), counted.rows)
            model.write().overwrite().save(subject_path(folder, "models", subject))
            return Outcome(subject, None, scored.select(*key, TIME, *RESULT_COLUMNS), model_importances(model), scores)
        except Exception as error:  # the other subjects go on; the run reports this one
            return Outcome(subject, failure(error))

    def fitted(rows: DataFrame, n: int) -> tuple[PipelineModel, DataFrame, list | None]:
        if mode == "baseline":
            return *train(rows, columns, key, n, **settings), None
        training, held_out = hash_split(rows, key)
        tuned = tune(training, columns, key, indexer=index_labels(rows), **settings)
        return tuned.model, tuned.model.transform(held_out), tuned.scores

    kinds = {name: kind for name, kind in prepared.dtypes}
    scored = ", ".join([*[f"`{name}` {kinds[name]}" for name in [*key, TIME]], f"{LABEL} string, {INDEXED_LABEL} double, prediction double, {PREDICTED_LABEL} string"])

    def commit(outcomes: list[Outcome], number: int) -> int:
        """Write a batch and its ledger rows; returns the next number. Rows that cannot be written whole are found subject by subject."""
        rows = [outcome.scored for outcome in outcomes if outcome.scored is not None]
        try:
            if rows:
                overwritten(reduce(DataFrame.unionByName, rows), f"{folder}/predictions/{BATCH}={number}")
        except Exception as error:
            if len(outcomes) == 1:
                return commit([Outcome(outcomes[0].subject, failure(error))], number)
            for outcome in outcomes:
                number = commit([outcome], number)
            return number
        entries = [(outcome.subject, outcome.reason, outcome.importances, outcome.scores) for outcome in outcomes]
        overwritten(spark.createDataFrame(entries, LEDGER).coalesce(1), f"{folder}/ledger/{BATCH}={number}")
        return number + 1

    ledger = read_if_any(spark, f"{folder}/ledger", f"{LEDGER}, {BATCH} int")
    number = (ledger.agg(F.max(BATCH)).first()[0] or 0) + 1
    counts = prepared.groupBy(SUBJECT).agg(F.count("*").alias("rows"), F.count_if(in_training(key)).alias("training_rows"))
    waiting = counts.join(ledger.select(SUBJECT), SUBJECT, "left_anti").orderBy(SUBJECT).toLocalIterator()
    with ThreadPoolExecutor(subjects_at_once) as pool:
        while batch := list(islice(waiting, subjects_per_batch)):
            number = commit(list(pool.map(inheritable_thread_target(spark)(fit), batch)), number)

    ledger = read_if_any(spark, f"{folder}/ledger", f"{LEDGER}, {BATCH} int")
    done = F.col(BATCH) < number
    return RunResult(
        read_if_any(spark, f"{folder}/predictions", f"{scored}, {BATCH} int").filter(done).drop(BATCH),
        ledger.filter("importances IS NOT NULL").select(SUBJECT, F.inline("importances")),
        cleaning,
        ledger.filter("scores IS NOT NULL").select(SUBJECT, F.inline("scores")),
        ledger.filter("reason IS NOT NULL").select(SUBJECT, "reason"),
        StoredModels(folder, ledger),
        prepared,
    )


def failure(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:500]


def overwritten(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_files(spark: SparkSession, path: str | list[str], folder: str | None = None, **options) -> RunResult:
    """Run over subjects' text files: they are parsed once into a stored table first."""
    folder = folder or shared_folder(spark, "run")
    ingest = lambda parsed: ingest_subject_files(spark, path, parsed, mode="overwrite", rescue=True)
    samples = stage(spark, folder, "samples", ingest, lambda parsed: read_by_subject(spark, parsed))
    return run(samples, [FILE_OFFSET, LINE_ORDER], folder=folder, **options)
