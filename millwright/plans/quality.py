"""Data-quality checks on the readings as they arrive."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import failed
from ..operators.lookup import lookup

# Bounds the checks use (rpm has no upper one), and the outlier limit.
SENSOR_BOUNDS = {
    "temperature_c": (-50, 200),
    "vibration_mm_s": (0, 100),
    "pressure_bar": (0, 500),
    "rpm": (0, None),
    "load_percent": (0, 100),
}
HOURS_BOUNDS = {"operating_hours": (0, None), "efficiency_percent": (0, 100)}
OUTLIER_DEVIATIONS = 3

SENSORS = [
    "temperature_c", "vibration_mm_s", "pressure_bar", "rpm",
    "load_percent", "efficiency_percent", "energy_consumption_kwh",
]


def completeness(readings: DataFrame) -> DataFrame:
    """Rows, and rows that have each critical field."""
    present = {
        "records_with_id": "record_id",
        "records_with_equipment": "equipment_id",
        "records_with_timestamp": "timestamp",
        "records_with_temp": "temperature_c",
        "records_with_vibration": "vibration_mm_s",
        "records_with_pressure": "pressure_bar",
        "records_with_failure_flag": "failure_flag",
    }
    return readings.agg(
        F.count(F.lit(1)).alias("total_records"),
        *[F.count(name).alias(label) for label, name in present.items()],
    )


def null_sensors(readings: DataFrame) -> DataFrame:
    """Readings that miss temperature, vibration, pressure or rpm."""
    missing = [F.col(name).isNull() for name in SENSORS[:4]]
    return readings.where(reduce(or_, missing)).select(
        "record_id", "equipment_id", "timestamp", *SENSORS[:3]
    )


def duplicate_readings(readings: DataFrame) -> DataFrame:
    """Machine and time pairs that occur more than once."""
    pairs = readings.groupBy("equipment_id", "timestamp")
    return pairs.agg(F.count(F.lit(1)).alias("duplicate_count")).where("duplicate_count > 1")


def duplicate_record_ids(readings: DataFrame) -> DataFrame:
    ids = readings.groupBy("record_id")
    return ids.agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def _outside(bounds: dict) -> Column:
    tests = []
    for name, (lower, upper) in bounds.items():
        tests.append(F.col(name) < lower)
        if upper is not None:
            tests.append(F.col(name) > upper)
    return reduce(or_, tests)


def out_of_range_sensors(readings: DataFrame) -> DataFrame:
    return readings.where(_outside(SENSOR_BOUNDS)).select("record_id", "equipment_id", *SENSOR_BOUNDS)


def illogical_hours(readings: DataFrame) -> DataFrame:
    return readings.where(_outside(HOURS_BOUNDS)).select("record_id", "equipment_id", *HOURS_BOUNDS)


def failure_consistency(readings: DataFrame) -> DataFrame:
    """Failures without a type or downtime, and downtime without a failure."""
    untyped = failed() & F.col("failure_type").isNull()
    untimed = failed() & F.col("downtime_minutes").isNull()
    idle = (F.col("failure_flag") == 0) & (F.col("downtime_minutes") > 0)
    return readings.where(untyped | idle | untimed).select(
        "record_id", "failure_flag", "failure_type", "downtime_minutes"
    )


def _deviations(value: str, mean: Column, std: Column) -> Column:
    return F.abs(F.col(value) - mean) / F.nullif(std, F.lit(0))


def temp_outliers(readings: DataFrame) -> DataFrame:
    """Readings more than 3 deviations from the mean temperature of all readings."""
    stats = readings.agg(
        F.struct(F.avg("temperature_c").alias("mean"), F.stddev_samp("temperature_c").alias("std"))
    ).scalar()
    return (
        readings.where(F.col("temperature_c").isNotNull())
        .select("record_id", "equipment_id", "temperature_c", stats.alias("stats"))
        .select(
            "record_id",
            "equipment_id",
            "temperature_c",
            F.col("stats.mean").alias("mean_temp"),
            _deviations("temperature_c", F.col("stats.mean"), F.col("stats.std")).alias("z_score"),
        )
        .where(F.col("z_score") > OUTLIER_DEVIATIONS)
    )


def vibration_outliers(readings: DataFrame) -> DataFrame:
    """Readings more than 3 deviations from the mean vibration of their equipment type."""
    measured = readings.where(F.col("vibration_mm_s").isNotNull())
    stats = measured.groupBy("equipment_type").agg(
        F.avg("vibration_mm_s").alias("mean_vib"), F.stddev_samp("vibration_mm_s").alias("std_vib")
    )
    joined = lookup(measured, stats, ["equipment_type"], spread=["record_id", "timestamp"])
    z_score = _deviations("vibration_mm_s", F.col("mean_vib"), F.col("std_vib"))
    return joined.select(
        "record_id", "equipment_id", "equipment_type", "vibration_mm_s", "mean_vib",
        z_score.alias("z_score"),
    ).where(F.col("z_score") > OUTLIER_DEVIATIONS)


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULLs per column, one row: of the sensors before cleaning, of all columns after."""
    return df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns or df.columns])


def dedup_report(df: DataFrame) -> DataFrame:
    """Rows that dropping repeated record ids removes; all missing ids count as one id."""
    per_id = df.groupBy("record_id").agg(F.count(F.lit(1)).alias("copies"))
    rows = F.coalesce(F.sum("copies"), F.lit(0))
    return per_id.agg(
        rows.alias("initial_rows"), (rows - F.count(F.lit(1))).alias("duplicates_removed")
    )
