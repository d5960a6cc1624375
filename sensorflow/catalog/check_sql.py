"""Building blocks of the checking SQL: one common table per processing step."""

from __future__ import annotations

from sensorflow.catalog.samples import NINE_SUBJECTS, RULE_PREDICTIONS_SQL, VARIED, sensor_samples_sql
from sensorflow.schema import ACTIVITY_NAMES, RESTING_HEART_RATE, SENSOR_COLUMNS, TEMPERATURE_COLUMNS

SENSORS_KEPT = [name for name in SENSOR_COLUMNS if "orientation" not in name]
DOUBLES_KEPT = ["heart_rate", *SENSORS_KEPT]
KEYS = ["subject", "event_id", '"timestamp"', "activityID"]
KEPT = [*KEYS, *DOUBLES_KEPT]
FEATURES = [*DOUBLES_KEPT, "heart_rate_minus_rest", "avg_temperature"]
# Decimals of compared metrics. Shares of counts end within 9 decimals for class sizes up to
# 512, so the last bit of a sum does not decide how a value is rounded.
DIGITS = 9
FRAME = "ROWS BETWEEN 20 PRECEDING AND CURRENT ROW"


def listed(names) -> str:
    return ", ".join(names)


def values(rows) -> str:
    def literal(value) -> str:
        return f"'{value}'" if isinstance(value, str) else str(value)

    return "VALUES " + ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)


RESTING = f"(SELECT * FROM ({values(RESTING_HEART_RATE.items())}) AS r(subject, resting_hr))"
NAMES = f"(SELECT * FROM ({values((c, n.strip()) for c, n in ACTIVITY_NAMES.items())}) AS n(activity_id, label))"


def steps(subject: str = NINE_SUBJECTS, activity: str = VARIED) -> str:
    """WITH clause: samples, cleaned, nulled, filled, labelled, complete, prepared, indexed."""
    nulled = [f"CASE WHEN NOT isnan({name}) THEN {name} END AS {name}" for name in DOUBLES_KEPT]
    complete = " AND ".join(f"{name} IS NOT NULL" for name in [*KEPT, "heart_rate_minus_rest", "label"])
    return f"""WITH samples AS ({sensor_samples_sql(subject, activity)}),
cleaned AS (SELECT {listed(KEPT)} FROM samples WHERE activityID <> 0),
nulled AS (SELECT {listed([*KEYS, *nulled])} FROM cleaned),
filled AS (SELECT {listed([*KEYS, *SENSORS_KEPT])},
  last_value(heart_rate IGNORE NULLS) OVER (PARTITION BY subject ORDER BY "timestamp", event_id {FRAME}) AS heart_rate
  FROM nulled),
labelled AS (SELECT filled.*, heart_rate - resting_hr AS heart_rate_minus_rest, label
  FROM filled LEFT JOIN {RESTING} USING (subject) LEFT JOIN {NAMES} ON activityID = activity_id),
complete AS (SELECT * FROM labelled WHERE {complete}),
prepared AS (SELECT *, ({' + '.join(TEMPERATURE_COLUMNS)}) / 3 AS avg_temperature FROM complete)
"""


def row_hash(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def index_sql(rows: str, label: str = "label") -> str:
    """Label index per subject over the named rows."""
    return (
        f"SELECT subject, {label}, count, CAST(row_number() OVER "
        f"(PARTITION BY subject ORDER BY count DESC, {label}) - 1 AS DOUBLE) AS indexed_label "
        f"FROM (SELECT subject, {label}, count(*) AS count FROM {rows} WHERE {label} IS NOT NULL GROUP BY ALL)"
    )


# Metrics from a table `predictions(subject, label, predicted_label)`.
METRICS = """confusion AS (SELECT subject, predicted_label, label, count(*) AS count FROM predictions GROUP BY ALL),
true_side AS (SELECT subject, label AS class, CAST(sum(count) AS BIGINT) AS rows,
  CAST(sum(CASE WHEN predicted_label = label THEN count ELSE 0 END) AS BIGINT) AS hits FROM confusion GROUP BY ALL),
predicted_side AS (SELECT subject, predicted_label AS class, CAST(sum(count) AS BIGINT) AS predicted
  FROM confusion GROUP BY ALL),
totals AS (SELECT subject, CAST(sum(count) AS BIGINT) AS total FROM confusion GROUP BY ALL),
rated AS (SELECT subject, class, rows, hits, coalesce(predicted, 0) AS predicted, total,
  coalesce(hits / nullif(predicted, 0), 0) AS precision, hits / rows AS recall,
  (coalesce(predicted, 0) - hits) / nullif(total - rows, 0) AS false_positive_rate
  FROM true_side LEFT JOIN predicted_side USING (subject, class) JOIN totals USING (subject)),
class_metrics AS (SELECT *,
  coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1,
  coalesce(1.25 * precision * recall / nullif(0.25 * precision + recall, 0), 0) AS f0_5 FROM rated),
subject_metrics AS (SELECT subject, CAST(sum(hits) AS BIGINT) / max(total) AS accuracy,
  sum(recall * rows / total) AS weighted_recall, sum(precision * rows / total) AS weighted_precision,
  sum(f1 * rows / total) AS weighted_f1, sum(f0_5 * rows / total) AS weighted_f0_5,
  sum(false_positive_rate * rows / total) AS weighted_false_positive_rate FROM class_metrics GROUP BY subject)
"""

RULE_METRICS = f"WITH predictions AS ({RULE_PREDICTIONS_SQL}),\n{METRICS}"

SUBJECT_MEASURES = [
    ("Accuracy", "accuracy"),
    ("Recall", "weighted_recall"),
    ("precision", "weighted_precision"),
    ("F1_Score", "weighted_f1"),
    ("F0_5_Score", "weighted_f0_5"),
    ("False_Pos_Rate", "weighted_false_positive_rate"),
]
CLASS_MEASURES = [("precision", "precision"), ("recall", "recall"), ("F1", "f1")]


def long_form(rows: str, keys: str, measures, digits: int | None = DIGITS) -> str:
    def value(column: str) -> str:
        return column if digits is None else f"round({column}, {digits})"

    return " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS measure, {value(column)} AS value FROM {rows}" for name, column in measures
    )


CLEANING = """counts AS (SELECT subject, count(*) AS all_rows,
  count(*) FILTER (WHERE activityID = 0) AS transient_rows,
  count(*) FILTER (WHERE activityID <> 0) AS kept_rows,
  (SELECT count(*) FROM complete WHERE complete.subject = samples.subject) AS complete_rows
  FROM samples GROUP BY subject)
"""
CLEANING_MEASURES = [
    ("All_Values", "all_rows"),
    ("After_activityID=0_Remove", "kept_rows"),
    ("AfterNaNRemove", "complete_rows"),
]
