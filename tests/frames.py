"""Hand-made readings: a complete default row, with the columns a test is about replaced."""

from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.schema import READINGS_SCHEMA

DEFAULT = {
    "record_id": 1,
    "timestamp": datetime(2024, 5, 6, 7, 8, 9),
    "date": date(2024, 5, 6),
    "shift": "Day",
    "equipment_id": "E1",
    "equipment_type": "Pump",
    "plant_area": "A",
    "manufacturer": "M",
    "temperature_c": 50.0,
    "vibration_mm_s": 5.0,
    "pressure_bar": 10.0,
    "rpm": 1000.0,
    "load_percent": 50.0,
    "efficiency_percent": 80.0,
    "energy_consumption_kwh": 10.0,
    "operating_hours": 100.0,
    "maintenance_type": "Preventive",
    "days_since_last_maintenance": 10.0,
    "failure_flag": 0,
    "failure_type": None,
    "downtime_minutes": 0.0,
    "failure_risk_level": "Low",
}

TEXT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in DEFAULT])

FEATURED_EXTRA = {
    "hour": 7, "day_of_week": 0, "month": 5, "year": 2024, "week": 19,
    "health_index": 70.0, "failure_probability": 30.0, "high_risk_flag": 0, "downtime_hours": 0.0,
    "operating_condition": "Fair",
}


def typed(spark, rows: list[dict]):
    """Typed readings; ids count up unless given."""
    filled = [DEFAULT | {"record_id": i + 1} | row for i, row in enumerate(rows)]
    data = [tuple(row[name] for name in DEFAULT) for row in filled]
    return spark.createDataFrame(data, READINGS_SCHEMA)


def raw(spark, rows: list[dict]):
    """Readings as text; values are given as the text of the cell."""
    filled = [DEFAULT | {"record_id": i + 1} | row for i, row in enumerate(rows)]
    data = [tuple(None if row[n] is None else str(row[n]) for n in DEFAULT) for row in filled]
    return spark.createDataFrame(data, TEXT_SCHEMA)


def featured(spark, rows: list[dict]):
    """Readings with chosen feature values."""
    fields = list(READINGS_SCHEMA.fields)
    for name, value in FEATURED_EXTRA.items():
        kind = {int: T.IntegerType(), float: T.DoubleType(), str: T.StringType()}[type(value)]
        fields.append(T.StructField(name, kind))
    default = DEFAULT | {"failure_type": "No Failure"} | FEATURED_EXTRA
    filled = [default | {"record_id": i + 1} | row for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(row[f.name] for f in fields) for row in filled], T.StructType(fields))


def column(df, name: str, by: str = "record_id") -> list:
    order = F.col(by).cast("bigint") if by == "record_id" else F.col(by)
    return [row[0] for row in df.orderBy(order).select(name).collect()]
