"""Readings derived from an `events` table, as the input of checks and benchmarks.

The expressions are plain SQL that Spark and the checking database both run; FIXTURES.md explains
the shapes and the planted defects.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import READINGS_SCHEMA

_FAILED = "(event_type = 'error' AND event_id % 4 = 0)"
_TIME = "ts + (event_id % 11) * INTERVAL '30' DAY"

TYPED = {
    "record_id": "event_id",
    "timestamp": _TIME,
    "date": f"CAST({_TIME} AS DATE)",
    "shift": "CASE WHEN event_id % 101 = 0 THEN NULL WHEN hour(ts) < 8 THEN 'Night'"
    " WHEN hour(ts) < 16 THEN 'Day' ELSE 'Evening' END",
    "equipment_id": "concat('EQ-', lpad(CAST(user_id AS STRING), 5, '0'))",
    "equipment_type": "CASE user_id % 5 WHEN 0 THEN 'Pump' WHEN 1 THEN 'Compressor'"
    " WHEN 2 THEN 'Motor' WHEN 3 THEN 'Turbine' ELSE 'Conveyor' END",
    "plant_area": "CASE user_id % 4 WHEN 0 THEN 'Area A' WHEN 1 THEN 'Area B'"
    " WHEN 2 THEN 'Area C' ELSE 'Area D' END",
    "manufacturer": "CASE user_id % 3 WHEN 0 THEN 'Maker X' WHEN 1 THEN 'Maker Y' ELSE 'Maker Z' END",
    "temperature_c": "CASE WHEN event_id % 41 = 0 THEN NULL"
    " WHEN event_id % 997 = 0 THEN CAST(250 AS DOUBLE)"
    " WHEN event_id % 499 = 0 THEN CAST(-80 AS DOUBLE)"
    " ELSE CAST(180 + 20 * (user_id % 5) + (event_id * 37) % 80"
    f" + CASE WHEN {_FAILED} THEN 80 ELSE 0 END AS DOUBLE) / 4 END",
    "vibration_mm_s": "CASE WHEN event_id % 43 = 0 THEN NULL"
    " WHEN event_id % 887 = 0 THEN CAST(-1 AS DOUBLE)"
    " WHEN event_id % 601 = 0 THEN CAST(150 AS DOUBLE)"
    " ELSE CAST(4 + (event_id * 13) % 48"
    f" + CASE WHEN {_FAILED} THEN 16 ELSE 0 END AS DOUBLE) / 4 END",
    "pressure_bar": "CASE WHEN event_id % 47 = 0 THEN NULL"
    " WHEN event_id % 701 = 0 THEN CAST(600 AS DOUBLE)"
    " ELSE CAST(10 + (event_id * 7) % 100 AS DOUBLE) / 2 END",
    "rpm": "CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 709 = 0 THEN CAST(-10 AS DOUBLE)"
    " ELSE CAST(600 + 10 * ((event_id * 11) % 240) AS DOUBLE) END",
    "load_percent": "CASE WHEN event_id % 61 = 0 THEN NULL"
    " WHEN event_id % 719 = 0 THEN CAST(120 AS DOUBLE)"
    " ELSE CAST(40 + (event_id * 17) % 160 AS DOUBLE) / 2 END",
    "efficiency_percent": "CASE WHEN event_id % 67 = 0 THEN NULL"
    " WHEN event_id % 727 = 0 THEN CAST(130 AS DOUBLE)"
    " ELSE CAST(120 + (event_id * 19) % 76 AS DOUBLE) / 2 END",
    "energy_consumption_kwh": "CASE WHEN event_id % 71 = 0 THEN NULL"
    " ELSE CAST(40 + (event_id * 23) % 400 AS DOUBLE) / 4 END",
    "operating_hours": "CASE WHEN event_id % 53 = 0 THEN NULL"
    " WHEN event_id % 733 = 0 THEN CAST(-5 AS DOUBLE)"
    " ELSE CAST(1000 * (user_id % 7) + (event_id % 11) * 720 + day(ts) * 24 + hour(ts) AS DOUBLE) END",
    "maintenance_type": "CASE event_id % 9 WHEN 0 THEN 'Preventive' WHEN 1 THEN 'Preventive'"
    " WHEN 2 THEN 'Corrective' WHEN 3 THEN 'Corrective' WHEN 4 THEN 'Predictive' ELSE NULL END",
    "days_since_last_maintenance": "CASE WHEN event_id % 73 = 0 THEN NULL"
    " ELSE CAST((event_id * 29) % 180 AS DOUBLE) END",
    "failure_flag": f"CASE WHEN {_FAILED} THEN 1 ELSE 0 END",
    "failure_type": f"CASE WHEN NOT {_FAILED} OR event_id % 5 = 0 THEN NULL"
    " WHEN event_id % 3 = 0 THEN 'Bearing' WHEN event_id % 3 = 1 THEN 'Electrical' ELSE 'Overheat' END",
    "downtime_minutes": f"CASE WHEN {_FAILED} AND event_id % 7 = 0 THEN NULL"
    f" WHEN {_FAILED} THEN CAST(15 + 5 * ((event_id * 31) % 41) AS DOUBLE)"
    " WHEN event_id % 211 = 0 THEN CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "failure_risk_level": "CASE WHEN event_id % 97 = 0 THEN 'Critical' WHEN event_id % 10 = 0 THEN 'High'"
    " WHEN event_id % 10 < 4 THEN 'Medium' WHEN event_id % 10 = 4 THEN NULL ELSE 'Low' END",
}

# Every event gives one reading; some give a second, equal one (a planted duplicate).
SECOND_COPY = "event_id % 50 = 0"

# The same readings as dirty text, over the typed columns.
RAW = {name: f"CAST({name} AS STRING)" for name in TYPED} | {
    "timestamp": "CASE WHEN record_id % 89 = 0 THEN 'bad' WHEN record_id % 91 = 0 THEN NULL"
    " ELSE CAST(timestamp AS STRING) END",
    "date": "CASE WHEN record_id % 113 = 0 THEN 'bad' ELSE CAST(date AS STRING) END",
    "equipment_id": "CASE WHEN record_id % 127 = 0 THEN NULL ELSE equipment_id END",
    "equipment_type": "CASE WHEN record_id % 131 = 0 THEN NULL ELSE equipment_type END",
    "temperature_c": "CASE WHEN record_id % 83 = 0 THEN 'abc' ELSE CAST(temperature_c AS STRING) END",
    "vibration_mm_s": "CASE WHEN equipment_type = 'Motor' THEN NULL ELSE CAST(vibration_mm_s AS STRING) END",
    "failure_flag": "CASE WHEN failure_flag = 1 THEN CASE record_id % 5 WHEN 0 THEN '1' WHEN 1 THEN 'Yes'"
    " WHEN 2 THEN 'y' WHEN 3 THEN 'Y' ELSE 'TRUE' END"
    " ELSE CASE record_id % 4 WHEN 0 THEN '0' WHEN 1 THEN 'No' WHEN 2 THEN 'n' ELSE NULL END END",
    "failure_risk_level": "CASE failure_risk_level WHEN 'Low' THEN 'LOW' WHEN 'Medium' THEN 'Med'"
    " WHEN 'High' THEN CASE WHEN record_id % 3 = 0 THEN 'severe' ELSE 'high' END"
    " ELSE failure_risk_level END",
}


def readings_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed readings with planted defects."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    copies = F.expr(f"CASE WHEN {SECOND_COPY} THEN array(0, 1) ELSE array(0) END")
    rows = events.select("event_id", "ts", "user_id", "event_type", F.explode(copies).alias("copy"))
    return rows.select(
        [
            F.expr(TYPED[field.name]).cast(field.dataType).alias(field.name)
            for field in READINGS_SCHEMA.fields
        ]
    )


def as_raw(readings: DataFrame) -> DataFrame:
    """The same readings as dirty text, as a CSV file would deliver them."""
    return readings.select([F.expr(text).alias(name) for name, text in RAW.items()])
