"""Sensor samples, sample lines and predictions derived from the given tables.

Each rule is one SQL expression that Spark and the checking engine both run, so
both sides of a check start from the same rows. The work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorflow.schema import SENSOR_COLUMNS, SENSOR_SCHEMA

# Activity of an event: all known codes, a code without a name, and no code.
VARIED = "CAST(CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 99 ELSE event_id % 25 END AS INT)"
# Activity of an event: transient, or one of four that the acceleration shows.
FOUR = "CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 + event_id % 4 END AS INT)"
# Activity of an event: transient, or one of two of unequal share that the acceleration shows.
UNEQUAL = "CAST(CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 4 ELSE 1 END AS INT)"
NINE_SUBJECTS = "'subject' || CAST(101 + user_id % 9 AS STRING)"
TWO_SUBJECTS = "'subject' || CAST(107 + user_id % 2 AS STRING)"
NAN = "CAST('NaN' AS DOUBLE)"
HEART_RATE_RULE = f"CASE WHEN event_id % 11 = 0 THEN value WHEN event_id % 3 = 0 THEN {NAN} END"
SPARK_SECONDS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1e6"
CHECK_SECONDS = "epoch_us(ts) / 1e6"

PREDICTION_RULE = (
    "CASE WHEN value < 10 THEN 'other' WHEN value < 30 THEN 'click' "
    "WHEN value < 60 THEN 'view' ELSE 'error' END"
)


def _sensor_rule(position: int, name: str, activity: str) -> str:
    step = position + 1
    if "temperature" in name:
        rule = f"CAST(30 + event_id % {step + 4} AS DOUBLE)"
    elif "3Dacc" in name:
        rule = f"CAST({activity} * 10 + (event_id * {step}) % 7 AS DOUBLE)"
    elif "3Dgyros" in name:
        rule = f"(event_id * {step}) % 23 * 0.5e0"
    elif "3Dmagnet" in name:
        rule = f"value * {step}"
    else:
        rule = f"CASE WHEN event_id % 2 = 0 THEN {NAN} ELSE 1e0 END"
    if name == "IMU_hand_3Dgyros_8":
        return f"CASE WHEN event_id % 53 = 0 THEN {NAN} ELSE {rule} END"
    if name == "IMU_chest_3Dgyros_9":
        return f"CASE WHEN event_id % 61 = 0 THEN NULL ELSE {rule} END"
    return rule


def _rules(subject: str, activity: str) -> list[str]:
    named = [(subject, "subject"), ("event_id", "event_id"), (activity, "activityID"), (HEART_RATE_RULE, "heart_rate")]
    named += [(_sensor_rule(i, name, activity), name) for i, name in enumerate(SENSOR_COLUMNS)]
    return [f"{rule} AS {name}" for rule, name in named]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor_samples(
    spark: SparkSession, sf_dir: str, subject: str = NINE_SUBJECTS, activity: str = VARIED
) -> DataFrame:
    """Every event as one sample of the sensor layout, with its id as tie-break."""
    rules = _rules(subject, activity)
    return table(spark, sf_dir, "events").selectExpr(*rules[:2], f"{SPARK_SECONDS} AS timestamp", *rules[2:])


def sensor_samples_sql(subject: str = NINE_SUBJECTS, activity: str = VARIED) -> str:
    rules = _rules(subject, activity)
    return f"SELECT {', '.join(rules)}, {CHECK_SECONDS} AS \"timestamp\" FROM events"


def sample_lines(samples: DataFrame) -> DataFrame:
    """Samples as text lines: fields in schema order, one space apart, nothing for null."""
    fields = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in SENSOR_SCHEMA.names]
    return samples.select("subject", F.concat_ws(" ", *fields).alias("value"))


def rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their type as true label and a label predicted by a fixed rule."""
    return table(spark, sf_dir, "events").selectExpr(
        f"{NINE_SUBJECTS} AS subject", "event_id", "event_type AS label", f"{PREDICTION_RULE} AS predicted_label"
    )


RULE_PREDICTIONS_SQL = (
    f"SELECT {NINE_SUBJECTS} AS subject, event_id, event_type AS label, {PREDICTION_RULE} AS predicted_label FROM events"
)
