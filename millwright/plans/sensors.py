"""Temperature and vibration measures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import failed, first_by, ratio, two_decimals
from ..operators.lookup import BROADCAST_ROWS, lookup
from ..operators.moments import ROWS, Rows
from ..operators.shared_table import write_shared

# Fixed value: an alert lies this many deviations above the mean of its type.
ALERT_DEVIATIONS = 2

TEMPERATURE = ("temperature_c", "temperature")
VIBRATION = ("vibration_mm_s", "vibration")


def _spread(values: Rows, column: str, label: str) -> list[Column]:
    return [
        values.mean(column).alias(f"avg_{label}"),
        values.least(column).alias(f"min_{label}"),
        values.most(column).alias(f"max_{label}"),
        values.deviation(column).alias(f"std_dev_{label}"),
    ]


def _normal() -> Column:
    return F.col("failure_flag") == 0


# --- temperature ----------------------------------------------------------------------------


def temp_overall(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return values.measured(readings, "temperature_c").agg(*_spread(values, *TEMPERATURE))


def temp_by_type(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return (
        values.measured(readings, "temperature_c")
        .groupBy("equipment_type")
        .agg(*_spread(values, *TEMPERATURE), values.count("temperature_c").alias("record_count"))
        .orderBy(F.desc("avg_temperature"))
    )


def temp_by_equipment(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    keys = ["equipment_id", "equipment_type", "plant_area"]
    return (
        values.measured(readings, "temperature_c")
        .groupBy(*keys)
        .agg(
            values.mean("temperature_c").alias("avg_temperature"),
            values.most("temperature_c").alias("max_temperature"),
            values.mean("temperature_c", failed()).alias("avg_temp_at_failure"),
        )
        .orderBy(first_by(F.desc("avg_temperature"), keys))
    )


def temp_daily_trend(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return (
        values.measured(readings, "temperature_c")
        .groupBy("equipment_id", F.to_date("timestamp").alias("date"))
        .agg(
            values.mean("temperature_c").alias("avg_daily_temperature"),
            values.most("temperature_c").alias("max_daily_temperature"),
            values.least("temperature_c").alias("min_daily_temperature"),
        )
        .orderBy("equipment_id", "date")
    )


def temp_normal_vs_failure(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    means = (
        values.measured(readings, "temperature_c")
        .groupBy("equipment_type")
        .agg(
            values.mean("temperature_c", _normal()).alias("avg_temp_normal"),
            values.mean("temperature_c", failed()).alias("avg_temp_failure"),
        )
    )
    difference = F.col("avg_temp_failure") - F.col("avg_temp_normal")
    return means.withColumn("temp_diff", difference).orderBy(F.desc("temp_diff"))


# --- vibration ------------------------------------------------------------------------------


def vib_overall(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return values.measured(readings, "vibration_mm_s").agg(*_spread(values, *VIBRATION))


def vib_by_type(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    variation = ratio(F.col("std_dev_vibration"), F.col("avg_vibration")) * 100
    return (
        values.measured(readings, "vibration_mm_s")
        .groupBy("equipment_type")
        .agg(*_spread(values, *VIBRATION))
        .withColumn("coefficient_variation", two_decimals(variation))
        .orderBy(F.desc("avg_vibration"))
    )


def vib_by_equipment(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    keys = ["equipment_id", "equipment_type", "plant_area", "manufacturer"]
    return (
        values.measured(readings, "vibration_mm_s")
        .groupBy(*keys)
        .agg(
            values.mean("vibration_mm_s").alias("avg_vibration"),
            values.most("vibration_mm_s").alias("max_vibration"),
            values.mean("vibration_mm_s", failed()).alias("avg_vib_at_failure"),
        )
        .orderBy(first_by(F.desc("avg_vibration"), keys))
    )


def vib_normal_vs_failure(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    normal, failure = F.col("avg_vib_normal"), F.col("avg_vib_failure")
    return (
        values.measured(readings, "vibration_mm_s")
        .groupBy("equipment_type")
        .agg(
            values.mean("vibration_mm_s", _normal()).alias("avg_vib_normal"),
            values.mean("vibration_mm_s", failed()).alias("avg_vib_failure"),
        )
        .withColumn("vib_increase_pct", two_decimals(ratio((failure - normal) * 100.0, normal)))
        .orderBy(F.desc("vib_increase_pct"))
    )


def vib_alerts(readings: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Readings above mean + 2 deviations of their equipment type; more types than `broadcast_rows` are joined by shuffle.

    The alerts are written before they are sorted: a sort runs its input twice, and this one is a
    scan of all readings.
    """
    measured = ROWS.measured(readings, "vibration_mm_s")
    limit = F.avg("vibration_mm_s") + ALERT_DEVIATIONS * F.stddev_samp("vibration_mm_s")
    limits = measured.groupBy("equipment_type").agg(limit.alias("upper_threshold"))
    alerts = (
        lookup(measured, limits, ["equipment_type"], spread=["record_id", "timestamp"], max_rows=broadcast_rows)
        .where(F.col("vibration_mm_s") > F.col("upper_threshold"))
        .select(
            "equipment_id", "equipment_type", "timestamp", "vibration_mm_s", "upper_threshold",
            "failure_flag",
        )
    )
    return write_shared(alerts).orderBy(
        first_by(F.desc("vibration_mm_s"), ["equipment_id", "timestamp"])
    )
