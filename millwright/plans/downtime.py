"""Repair time and downtime of failures whose downtime is known."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_month, failed, first_by, ratio, two_decimals
from ..operators.lookup import join_written
from ..operators.moments import ROWS, Rows
from ..operators.shared_table import write_shared

MACHINE = ["equipment_id", "equipment_type", "plant_area"]

# Fixed values.
MIN_FAILURES_FOR_AVERAGE = 3
TOP_MACHINES = 10


DOWN = "downtime_minutes"


def _repairs(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return values.measured(readings.where(failed()), DOWN)


def _mean(values: Rows = ROWS) -> Column:
    return values.mean(DOWN)


def _total(values: Rows = ROWS) -> Column:
    return values.total(DOWN)


def _least(values: Rows = ROWS) -> Column:
    return values.least(DOWN)


def _most(values: Rows = ROWS) -> Column:
    return values.most(DOWN)


def _events(values: Rows = ROWS) -> Column:
    """Repairs: the rows of `_repairs`, which all have a downtime."""
    return values.count(DOWN)


def _mean_hours(values: Rows = ROWS) -> Column:
    return two_decimals(_mean(values) / 60.0)


def _total_hours(values: Rows = ROWS) -> Column:
    return two_decimals(_total(values) / 60.0)


# --- time to repair -------------------------------------------------------------------------


def mttr_by_type(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return (
        _repairs(readings, values)
        .groupBy("equipment_type")
        .agg(
            _events(values).alias("total_failures"),
            _mean(values).alias("mttr_minutes"),
            _least(values).alias("min_downtime"),
            _most(values).alias("max_downtime"),
            values.deviation(DOWN).alias("std_dev_minutes"),
            _mean_hours(values).alias("mttr_hours"),
        )
        .orderBy(F.desc("mttr_minutes"))
    )


def mttr_by_equipment(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    keys = ["equipment_id", "equipment_type", "manufacturer"]
    return (
        _repairs(readings, values)
        .groupBy(*keys)
        .agg(
            _events(values).alias("failure_count"),
            _mean(values).alias("mttr_minutes"),
            _total(values).alias("total_downtime_minutes"),
            _mean_hours(values).alias("mttr_hours"),
        )
        .orderBy(first_by(F.desc("mttr_minutes"), keys))
    )


def mttr_by_failure_type(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return (
        _repairs(readings, values)
        .where(F.col("failure_type").isNotNull())
        .groupBy("failure_type")
        .agg(
            _events(values).alias("failure_count"),
            _mean(values).alias("mttr_minutes"),
            _least(values).alias("min_repair_time"),
            _most(values).alias("max_repair_time"),
            _mean_hours(values).alias("mttr_hours"),
        )
        .orderBy(F.desc("mttr_minutes"))
    )


def mttr_monthly(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return (
        _repairs(readings, values)
        .groupBy(*by_month())
        .agg(
            _events(values).alias("failure_count"),
            _mean(values).alias("mttr_minutes"),
            _mean_hours(values).alias("mttr_hours"),
        )
        .orderBy("year", "month")
    )


# --- downtime -------------------------------------------------------------------------------


def downtime_overall(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return _repairs(readings, values).agg(
        _total(values).alias("total_downtime_minutes"),
        _total_hours(values).alias("total_downtime_hours"),
        two_decimals(_total(values) / 1440.0).alias("total_downtime_days"),
        _events(values).alias("total_failure_events"),
        _mean(values).alias("avg_downtime_per_failure"),
    )


def _most_downtime_first(repairs: DataFrame, keys: list[str], *measures: Column, values: Rows = ROWS) -> DataFrame:
    totals = [
        _total(values).alias("total_downtime_minutes"),
        _total_hours(values).alias("total_downtime_hours"),
    ]
    rows = repairs.groupBy(*keys).agg(*totals, *measures)
    return rows.orderBy(first_by(F.desc("total_downtime_minutes"), keys))


def downtime_by_type(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return _most_downtime_first(
        _repairs(readings, values),
        ["equipment_type"],
        _events(values).alias("failure_count"),
        _mean(values).alias("avg_downtime_per_failure"),
        _least(values).alias("min_downtime"),
        _most(values).alias("max_downtime"),
        values=values,
    )


def downtime_by_area(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return _most_downtime_first(
        _repairs(readings, values),
        ["plant_area"],
        F.count_distinct("equipment_id").alias("affected_equipment"),
        _events(values).alias("failure_count"),
        values=values,
    )


def downtime_monthly(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    return (
        _repairs(readings, values)
        .groupBy(*by_month())
        .agg(
            _total(values).alias("total_downtime_minutes"),
            _total_hours(values).alias("total_downtime_hours"),
            _events(values).alias("failure_count"),
            _mean(values).alias("avg_downtime"),
        )
        .orderBy("year", "month")
    )


def downtime_by_failure_type(readings: DataFrame, values: Rows = ROWS) -> DataFrame:
    """Share of each failure type in the downtime of all failures, those without a type included."""
    all_failures = readings.where(failed()).agg(_total(values)).scalar()
    totals = _most_downtime_first(
        _repairs(readings, values).where(F.col("failure_type").isNotNull()),
        ["failure_type"],
        _events(values).alias("occurrence_count"),
        _mean(values).alias("avg_downtime_per_occurrence"),
        values=values,
    )
    share = two_decimals(ratio(F.col("total_downtime_minutes") * 100.0, all_failures))
    return totals.withColumn("percentage_of_total_downtime", share)


def downtime_by_equipment(readings: DataFrame) -> DataFrame:
    return _most_downtime_first(
        _repairs(readings),
        [*MACHINE, "manufacturer"],
        _events().alias("failure_count"),
        _mean().alias("avg_downtime_per_failure"),
        _least().alias("min_downtime"),
        _most().alias("max_downtime"),
        F.max("timestamp").alias("last_failure_timestamp"),
    )


def downtime_top10(readings: DataFrame) -> DataFrame:
    totals = _most_downtime_first(
        _repairs(readings),
        MACHINE,
        _events().alias("failure_count"),
        _mean().alias("avg_downtime_per_failure"),
    )
    return totals.limit(TOP_MACHINES)


def downtime_worst_average(readings: DataFrame) -> DataFrame:
    """Machines with enough failures for an average to mean something."""
    return (
        _repairs(readings)
        .groupBy(*MACHINE)
        .agg(
            _events().alias("failure_count"),
            _mean().alias("avg_downtime_per_failure"),
            _total().alias("total_downtime_minutes"),
            _mean_hours().alias("avg_downtime_hours"),
        )
        .where(F.col("failure_count") >= MIN_FAILURES_FOR_AVERAGE)
        .orderBy(first_by(F.desc("avg_downtime_per_failure"), MACHINE))
    )


def downtime_vs_benchmark(readings: DataFrame) -> DataFrame:
    """Each machine against the mean of the machines of its type."""
    machines = write_shared(
        _repairs(readings)
        .groupBy("equipment_id", "equipment_type")
        .agg(_total().alias("equipment_total_downtime"), _mean().alias("equipment_avg_downtime"))
    )
    types = write_shared(
        machines.groupBy("equipment_type").agg(
            F.avg("equipment_total_downtime").alias("type_benchmark_total"),
            F.avg("equipment_avg_downtime").alias("type_benchmark_avg"),
        )
    )
    total, benchmark = F.col("equipment_total_downtime"), F.col("type_benchmark_total")
    category = (
        F.when(total > benchmark * 1.5, "Critical")
        .when(total > benchmark * 1.2, "Above Average")
        .when(total < benchmark * 0.8, "Below Average")
        .otherwise("Average")
    )
    variance = two_decimals(ratio((total - benchmark) * 100.0, benchmark))
    return (
        join_written(machines, types, ["equipment_type"], spread=["equipment_id"])
        .select(
            "equipment_id",
            "equipment_type",
            "equipment_total_downtime",
            "equipment_avg_downtime",
            "type_benchmark_total",
            "type_benchmark_avg",
            variance.alias("variance_from_benchmark_pct"),
            category.alias("performance_category"),
        )
        .orderBy(first_by(F.desc("variance_from_benchmark_pct"), ["equipment_id", "equipment_type"]))
    )
