"""Column layout and fixed values of the sensor samples."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the recording format: body parts in file order, and per body
# part the measured quantities with the first and last column number.
BODY_PARTS = ("hand", "chest", "ankle")
QUANTITIES = (
    ("temperature", 1, 1),
    ("3Dacc", 2, 7),
    ("3Dgyros", 8, 10),
    ("3Dmagnet", 11, 13),
    ("orientation", 14, 17),
)

SUBJECT = "subject"
TIME = "timestamp"
ACTIVITY = "activityID"
HEART_RATE = "heart_rate"
LABEL = "label"
INDEXED_LABEL = "indexed_label"
FEATURES = "features"
PREDICTED_LABEL = "predicted_label"
BAD_LINE = "bad_line"
SOURCE_FILE = "source_file"

TRANSIENT_CODE = 0
FILL_ROWS = 20
DROPPED_QUANTITY = "orientation"
SEED = 42

SENSOR_COLUMNS = [
    f"IMU_{part}_{quantity}_{number}"
    for part in BODY_PARTS
    for quantity, first, last in QUANTITIES
    for number in range(first, last + 1)
]
TEMPERATURE_COLUMNS = [f"IMU_{part}_temperature_1" for part in BODY_PARTS]

SENSOR_SCHEMA = T.StructType(
    [
        T.StructField(TIME, T.DoubleType()),
        T.StructField(ACTIVITY, T.IntegerType()),
        T.StructField(HEART_RATE, T.DoubleType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in SENSOR_COLUMNS]
)

# Resting heart rate of each subject.
RESTING_HEART_RATE = {
    "subject101": 75,
    "subject102": 74,
    "subject103": 68,
    "subject104": 58,
    "subject105": 70,
    "subject106": 60,
    "subject107": 60,
    "subject108": 66,
    "subject109": 54,
}

# Activity name of each code. Code 16 carries a leading space in
# the source data; `operators.derive.name_labels` trims it unless told not to.
ACTIVITY_NAMES = {
    0: "Zero_Remove",
    1: "lying",
    2: "sitting",
    3: "standing",
    4: "walking",
    5: "running",
    6: "cycling",
    7: "Nordic_walking",
    8: "unknown",
    9: "watching_TV",
    10: "computer_work",
    11: "car_driving",
    12: "ascending_stairs",
    13: "descending_stairs",
    14: "unknown",
    15: "unknown",
    16: " vacuum_cleaning",
    17: "ironing",
    18: "folding_laundry",
    19: "house_cleaning",
    20: "playing_soccer",
    21: "unknown",
    22: "unknown",
    23: "unknown",
    24: "rope_jumping",
}
