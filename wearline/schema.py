"""Schemas, sensor sets and thresholds shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of a sensor log line, the sensors in use for each
# dataset, label cap, window length and the alert limits.
SETTINGS = ["setting_1", "setting_2", "setting_3"]
LOG_COLUMNS = ["unit", "cycle", *SETTINGS, *[f"s{i}" for i in range(1, 22)]]
SUBSETS = (1, 2, 3, 4)
ALL_SENSORS = ["s2", "s3", "s4", "s7", "s8", "s9", "s11", "s12", "s13", "s14", "s15", "s17", "s20", "s21"]
SENSORS = {
    1: ["s2", "s3", "s4", "s7", "s8", "s9", "s11", "s12", "s13", "s14", "s17", "s20", "s21"],
    2: ALL_SENSORS,
    3: ALL_SENSORS,
    4: ALL_SENSORS,
}
RUL_CAP = 125
WINDOW = 30
CRITICAL_LIMIT = 10
WARNING_LIMIT = 30
LATE_LIMIT = 10
EARLY_LIMIT = -10
LIFE_STAGES = [0.20, 0.30, 0.42, 0.52, 0.80]
SINGLE_LIFE_STAGE = 0.40
LIFE_STAGE_SPAN = 0.60
RUL_BRACKETS = [
    (5, "0–5   (Critical)"),
    (10, "6–10  (Critical)"),
    (20, "11–20 (Warning)"),
    (30, "21–30 (Warning)"),
    (36, "31–36 (Healthy)"),
    (None, "37+   (Healthy)"),
]
SENSOR_LABELS = {
    "s2": "Fan Inlet Temp (°R)",
    "s3": "HPC Outlet Temp (°R)",
    "s4": "LPT Outlet Temp (°R)",
    "s7": "HPC Outlet Pressure (psia)",
    "s8": "Fan Inlet Flow (lbm/s)",
    "s9": "Core Speed (rpm)",
    "s11": "HPC Outlet Static P (psia)",
    "s12": "Ratio Fan P / T (—)",
    "s13": "Corrected Core Speed (rpm)",
    "s14": "Bypass Ratio (—)",
    "s15": "Bleed Enthalpy (—)",
    "s17": "HP Turbine Cool Air Flow (lbm/s)",
    "s20": "LP Turbine Cool Air Flow (lbm/s)",
    "s21": "Fan Speed Demand (rpm)",
}
# Boosted tree settings of the product model; tests fit fewer trees.
GBT_PARAMS = {
    "maxIter": 1000,
    "maxDepth": 4,
    "stepSize": 0.02,
    "subsamplingRate": 0.9,
    "featureSubsetStrategy": "0.8",
    "seed": 42,
}

SERIES_KEYS = ["subset", "unit"]

LOG_SCHEMA = T.StructType(
    [T.StructField("unit", T.IntegerType()), T.StructField("cycle", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in LOG_COLUMNS[2:]]
)

_READING_FIELDS = [
    T.StructField("cycle", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in SETTINGS + ALL_SENSORS],
]
SNAPSHOT_SCHEMA = T.StructType(
    [T.StructField("subset", T.IntegerType()), T.StructField("engine_id", T.IntegerType()), *_READING_FIELDS]
)
BATCH_SCHEMA = T.StructType([T.StructField("instances", T.ArrayType(SNAPSHOT_SCHEMA))])
SEQUENCE_SCHEMA = T.StructType(
    [
        T.StructField("subset", T.IntegerType()),
        T.StructField("engine_id", T.IntegerType()),
        T.StructField("history", T.ArrayType(T.StructType(_READING_FIELDS))),
    ]
)
TRUTH_SCHEMA = T.StructType(
    [T.StructField("prediction_id", T.LongType()), T.StructField("true_rul", T.DoubleType())]
)
SELECTION_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("engine_ids", T.ArrayType(T.IntegerType())),
        T.StructField("max_engines", T.IntegerType()),
    ]
)
REQUEST_SCHEMAS = {
    "snapshot": SNAPSHOT_SCHEMA,
    "batch": BATCH_SCHEMA,
    "sequence": SEQUENCE_SCHEMA,
    "truth": TRUTH_SCHEMA,
    "selection": SELECTION_SCHEMA,
}


def feature_columns(sensors: list[str]) -> list[str]:
    """Ordered feature names: sensors, trailing means, trailing deviations, cycle."""
    return [*sensors, *[f"{s}_rm" for s in sensors], *[f"{s}_rs" for s in sensors], "cycle"]
