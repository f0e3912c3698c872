"""High-risk equipment, risk levels and failure probability."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    by_month, failure_count, failure_rate, first_by, high_risk, percent, severity_order,
)
from ..operators.lookup import lookup
from ..operators.sketches import EXACT, Machines

# --- high risk ------------------------------------------------------------------------------


def _equipment(label: str, machines: Machines = EXACT) -> Column:
    return machines.distinct().alias(label)


def _records(label: str, machines: Machines = EXACT) -> Column:
    return machines.records().alias(label)


def high_risk_count(readings: DataFrame, machines: Machines = EXACT) -> DataFrame:
    return readings.where(high_risk()).agg(
        _equipment("high_risk_equipment_count", machines), _records("high_risk_records", machines)
    )


def high_risk_by_type_area(readings: DataFrame, machines: Machines = EXACT) -> DataFrame:
    return (
        readings.where(high_risk())
        .groupBy("equipment_type", "plant_area")
        .agg(_equipment("high_risk_equipment", machines), _records("high_risk_records", machines))
        .orderBy(F.desc("high_risk_equipment"))
    )


def high_risk_equipment_detail(readings: DataFrame) -> DataFrame:
    keys = ["equipment_id", "equipment_type", "plant_area", "manufacturer"]
    return (
        readings.where(high_risk())
        .groupBy(*keys)
        .agg(
            _records("high_risk_occurrences"),
            F.avg("temperature_c").alias("avg_temp"),
            F.avg("vibration_mm_s").alias("avg_vibration"),
            F.max("timestamp").alias("last_high_risk_timestamp"),
        )
        .orderBy(first_by(F.desc("high_risk_occurrences"), keys))
    )


def high_risk_monthly(readings: DataFrame, machines: Machines = EXACT) -> DataFrame:
    return (
        readings.where(high_risk())
        .groupBy(*by_month())
        .agg(_equipment("high_risk_equipment", machines), _records("high_risk_records", machines))
        .orderBy("year", "month")
    )


# --- failure probability --------------------------------------------------------------------


def failure_probability_historical(readings: DataFrame) -> DataFrame:
    machines = readings.groupBy("equipment_id").agg(
        F.count(F.lit(1)).alias("total_records"),
        failure_count().alias("failure_count"),
        F.avg("temperature_c").alias("avg_temp"),
        F.avg("vibration_mm_s").alias("avg_vib"),
        F.avg("efficiency_percent").alias("avg_efficiency"),
    )
    failures, records = F.col("failure_count"), F.col("total_records")
    rate = failures * 100.0 / records
    category = (
        F.when(rate >= 10, "Very High").when(rate >= 5, "High").when(rate >= 2, "Medium")
        .otherwise("Low")
    )
    return machines.select(
        "equipment_id",
        "total_records",
        "failure_count",
        percent(failures, records).alias("historical_failure_probability_pct"),
        "avg_temp",
        "avg_vib",
        "avg_efficiency",
        category.alias("predicted_risk_category"),
    ).orderBy(first_by(F.desc("historical_failure_probability_pct"), ["equipment_id"]))


def failure_probability_by_condition(readings: DataFrame) -> DataFrame:
    temperature, vibration = F.col("temperature_c"), F.col("vibration_mm_s")
    heat = (
        F.when(temperature >= 80, "High Temp").when(temperature >= 60, "Medium Temp")
        .otherwise("Normal Temp")
    )
    shaking = (
        F.when(vibration >= 10, "High Vibration").when(vibration >= 5, "Medium Vibration")
        .otherwise("Normal Vibration")
    )
    return (
        readings.where(temperature.isNotNull() & vibration.isNotNull())
        .groupBy("equipment_type", heat.alias("temp_category"), shaking.alias("vib_category"))
        .agg(
            F.count(F.lit(1)).alias("total_records"),
            failure_count().alias("failures"),
            failure_rate().alias("failure_probability_pct"),
        )
        .orderBy(F.desc("failure_probability_pct"))
    )


def failure_probability_current(readings: DataFrame) -> DataFrame:
    """Latest reading of each machine, with its type's failure rate scaled by its risk level.

    `row_number() = 1` keeps one row per machine and task before the shuffle.
    """
    newest = Window.partitionBy("equipment_id").orderBy(
        F.col("timestamp").desc_nulls_last(), F.col("record_id").desc_nulls_last()
    )
    latest = (
        readings.select(
            "equipment_id", "equipment_type", "temperature_c", "vibration_mm_s",
            "efficiency_percent", "failure_risk_level", "timestamp", "record_id",
        )
        .withColumn("position", F.row_number().over(newest))
        .where("position = 1")
    )
    baseline = readings.groupBy("equipment_type").agg(failure_rate().alias("baseline_failure_rate"))
    level = F.col("failure_risk_level")
    factor = (
        F.when(level == "High", Decimal("3.0")).when(level == "Medium", Decimal("1.5"))
        .otherwise(Decimal("0.5"))
    )
    adjusted = (F.col("baseline_failure_rate") * factor).cast("decimal(10,3)")
    return (
        lookup(latest, baseline, ["equipment_type"], spread=["equipment_id"])
        .select(
            "equipment_id",
            "equipment_type",
            F.col("temperature_c").alias("current_temp"),
            F.col("vibration_mm_s").alias("current_vibration"),
            F.col("efficiency_percent").alias("current_efficiency"),
            F.col("failure_risk_level").alias("current_risk_level"),
            "baseline_failure_rate",
            adjusted.alias("adjusted_failure_probability_pct"),
        )
        .orderBy(first_by(F.desc("adjusted_failure_probability_pct"), ["equipment_id"]))
    )


# --- risk levels ----------------------------------------------------------------------------


def _levels(readings: DataFrame, keys: list, machines: Machines = EXACT) -> DataFrame:
    return (
        readings.where(F.col("failure_risk_level").isNotNull())
        .groupBy(*keys, "failure_risk_level")
        .agg(_records("record_count", machines), _equipment("equipment_count", machines))
    )


def risk_distribution(readings: DataFrame, machines: Machines = EXACT) -> DataFrame:
    everything = F.sum("record_count").over(Window.partitionBy())  # over one row for each level
    return (
        _levels(readings, [], machines)
        .withColumn("percentage", percent(F.col("record_count"), everything))
        .orderBy(severity_order())
    )


def _levels_within(readings: DataFrame, key: str, label: str, machines: Machines = EXACT) -> DataFrame:
    """Share of each level within a key; the window runs over one row per key and level."""
    of_key = F.sum("record_count").over(Window.partitionBy(key))
    return (
        _levels(readings, [key], machines)
        .withColumn(label, percent(F.col("record_count"), of_key))
        .orderBy(key, severity_order())
    )


def risk_distribution_by_type(readings: DataFrame, machines: Machines = EXACT) -> DataFrame:
    return _levels_within(readings, "equipment_type", "percentage_within_type", machines)


def risk_distribution_by_area(readings: DataFrame, machines: Machines = EXACT) -> DataFrame:
    return _levels_within(readings, "plant_area", "percentage_within_area", machines)


def risk_trend_monthly(readings: DataFrame, machines: Machines = EXACT) -> DataFrame:
    return _levels(readings, by_month(), machines).orderBy("year", "month", severity_order())
