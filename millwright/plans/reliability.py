"""Failure rates and time between failures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_month, failed, first_by, percent, ratio, two_decimals
from ..operators.intervals import previous_pairs
from ..operators.moments import ROWS, Rows


def _failure_rate(readings: DataFrame, keys: list, values: Rows, total: str = "failures") -> DataFrame:
    return readings.groupBy(*keys).agg(
        values.rows().alias("total_records"),
        values.rows_when(failed()).alias(total),
        percent(values.rows_when(failed()), values.rows()).alias("failure_rate_pct"),
    )


def failure_rate_overall(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return _failure_rate(readings, [], values, "total_failures")


def failure_rate_by_type(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return _failure_rate(readings, ["equipment_type"], values).orderBy(F.desc("failure_rate_pct"))


def failure_rate_by_equipment(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    keys = ["equipment_id", "equipment_type", "plant_area"]
    return _failure_rate(readings, keys, values).orderBy(first_by(F.desc("failure_rate_pct"), keys))


def failure_rate_monthly(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return _failure_rate(readings, by_month(), values).orderBy("year", "month")


def failure_rate_by_shift(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return _failure_rate(readings, ["shift"], values).orderBy(F.desc("failure_rate_pct"))


def mtbf_by_equipment(readings: DataFrame) -> DataFrame:
    """Meter hours between consecutive failures of a machine.

    The meter of the earlier failure counts as 0 when it was not read, or when the machine is
    unknown.
    """
    failures = readings.where(failed()).select(
        "equipment_id", "equipment_type", "timestamp", "record_id", "operating_hours"
    )
    pairs = previous_pairs(
        failures, "equipment_id", "timestamp", "record_id", ["equipment_type", "operating_hours"]
    )
    known = F.when(F.col("equipment_id").isNotNull(), F.col("previous.operating_hours"))
    hours = F.col("current.operating_hours") - F.coalesce(known, F.lit(0.0))
    intervals = pairs.select(
        "equipment_id", F.col("current.equipment_type").alias("equipment_type"), hours.alias("hours")
    )
    return (
        intervals.groupBy("equipment_id", "equipment_type")
        .agg(
            F.count(F.lit(1)).alias("failure_intervals"),
            F.avg("hours").alias("mtbf_hours"),
            F.min("hours").alias("min_time_between_failures"),
            F.max("hours").alias("max_time_between_failures"),
            F.stddev_samp("hours").alias("std_dev_hours"),
        )
        .orderBy(first_by(F.asc("mtbf_hours"), ["equipment_id", "equipment_type"]))
    )


def _hours_per_failure(readings: DataFrame, keys: list[str], values: Rows) -> DataFrame:
    return (
        readings.groupBy(*keys)
        .agg(
            values.total("operating_hours").alias("total_operating_hours"),
            values.rows_when(failed()).alias("total_failures"),
            two_decimals(ratio(values.total("operating_hours"), values.rows_when(failed()))).alias("mtbf_hours"),
        )
        .orderBy(F.desc("mtbf_hours"))
    )


def mtbf_by_type(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return _hours_per_failure(readings, ["equipment_type"], values)


def mtbf_by_area(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return _hours_per_failure(readings, ["plant_area", "equipment_type"], values)
