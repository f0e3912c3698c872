"""Maintenance measures that are only declared by name; the definitions are this library's own."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import failed, hours_between
from ..schema import PLANNED_MAINTENANCE, UNPLANNED_MAINTENANCE
from ..sources.readings import MONTH


def planned_unplanned_ratio(readings: DataFrame) -> DataFrame:
    """Readings with planned and with unplanned maintenance per equipment type, and their ratio."""
    kind = F.col("maintenance_type")
    return (
        readings.groupBy("equipment_type")
        .agg(
            F.count_if(kind.isin(PLANNED_MAINTENANCE)).alias("planned_count"),
            F.count_if(kind.isin(UNPLANNED_MAINTENANCE)).alias("unplanned_count"),
        )
        .withColumn("planned_unplanned_ratio", F.try_divide("planned_count", "unplanned_count"))
        .orderBy("equipment_type")
    )


def maintenance_frequency(readings: DataFrame) -> DataFrame:
    """Readings with a maintenance type per machine and month."""
    return (
        readings.where(F.col("maintenance_type").isNotNull())
        .groupBy("equipment_id", F.year("date").alias("year"), F.month("date").alias("month"))
        .agg(F.count(F.lit(1)).alias("maintenance_count"))
        .orderBy("equipment_id", "year", "month")
    )


def failure_trend_by_machine(readings: DataFrame) -> DataFrame:
    """Failures per machine and month."""
    return (
        readings.where(failed())
        .groupBy("equipment_id", F.year("date").alias("year"), F.month("date").alias("month"))
        .agg(F.count(F.lit(1)).alias("failure_count"))
        .orderBy("equipment_id", "year", "month")
    )


def remaining_useful_life(readings: DataFrame) -> DataFrame:
    """Mean hours between a machine's failures less the hours since its last one, at least 0.

    Needs two failures at known times. "Now" is the machine's latest reading. The mean gap is the
    span from first to last failure over the number of gaps, so nothing is ordered.
    """
    failure_time = F.when(failed(), F.col("timestamp"))
    machines = readings.groupBy("equipment_id").agg(
        F.min(failure_time).alias("first_failure"),
        F.max(failure_time).alias("last_failure"),
        F.count(failure_time).alias("failure_count"),
        F.max("timestamp").alias("last_reading"),
    )
    mean_gap = hours_between(F.col("first_failure"), F.col("last_failure")) / (F.col("failure_count") - 1)
    since = hours_between(F.col("last_failure"), F.col("last_reading"))
    return (
        machines.where("failure_count > 1")
        .select(
            "equipment_id",
            "failure_count",
            mean_gap.alias("mean_hours_between_failures"),
            since.alias("hours_since_last_failure"),
        )
        .withColumn(
            "remaining_useful_life_hours",
            F.greatest(
                F.col("mean_hours_between_failures") - F.col("hours_since_last_failure"), F.lit(0.0)
            ),
        )
        .orderBy("remaining_useful_life_hours", "equipment_id")
    )


def downtime_risk(featured: DataFrame) -> DataFrame:
    """Expected downtime per machine: mean failure probability times mean downtime of a failure."""
    return (
        featured.groupBy("equipment_id")
        .agg(
            F.avg("failure_probability").alias("avg_failure_probability"),
            F.avg(F.when(failed(), F.col("downtime_hours"))).alias("avg_downtime_per_failure"),
        )
        .withColumn(
            "downtime_risk_hours",
            F.col("avg_failure_probability") / 100 * F.coalesce("avg_downtime_per_failure", F.lit(0.0)),
        )
        .orderBy(F.desc("downtime_risk_hours"), "equipment_id")
    )


def filtered_view(
    featured: DataFrame,
    equipment_id: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    maintenance_type: str | None = None,
    operating_condition: str | None = None,
    by_month: bool = False,
) -> DataFrame:
    """Readings of a machine, a time period start <= t < end, a maintenance type, a condition.

    Any measure can be taken of the result; the tests reach the scan where it stores the column. With `by_month`
    columns year and month are taken for those of the time: a table stored by them reads the folders of the period only.
    """
    wanted = {
        "equipment_id": equipment_id,
        "maintenance_type": maintenance_type,
        "operating_condition": operating_condition,
    }
    rows = featured
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if start is not None:
        rows = rows.where(F.col("timestamp") >= _time(start))
    if end is not None:
        rows = rows.where(F.col("timestamp") < _time(end))
    if by_month:
        year, month = map(F.col, MONTH)
        month = year * 12 + month
        if start is not None:
            rows = rows.where(month >= start.year * 12 + start.month)
        if end is not None:
            rows = rows.where(month <= end.year * 12 + end.month)
    return rows


def _time(moment: datetime) -> Column:
    """The moment as written, whatever the time zone of the session."""
    return F.lit(str(moment)).cast("timestamp_ntz")
