"""Reports on clean readings with features.

The mean time between a machine's failures needs no ordering: the gaps of one machine add up to its
last failure time minus its first, so each machine gives one sum and one count. Machines are reduced
to one row each first; counting machines then needs no DISTINCT.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import band, clip, failed, hours_between, order_of
from ..operators.ranking import average_rank
from ..operators.shared_table import write_shared
from ..schema import CONDITION_BANDS

MACHINE = ["equipment_id", "equipment_type", "plant_area"]

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
RISK_LEVELS = ["Low", "Medium", "High", "Critical"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM"]
ALERT_HEALTH, ALERT_PROBABILITY = 40, 80
CRITICAL_HEALTH, CRITICAL_PROBABILITY = 30, 90
SERIOUS_HEALTH, SERIOUS_PROBABILITY = 50, 70
SHOWN_DOWNTIME, SHOWN_HEALTH, SHOWN_MONTHS, SHOWN_ALERTS = 10, 10, 12, 20

_MEANS = {
    "avg_temperature": "temperature_c",
    "avg_vibration": "vibration_mm_s",
    "avg_health_index": "health_index",
    "avg_failure_probability": "failure_probability",
}


def _at_failure(value: str) -> Column:
    return F.when(failed(), F.col(value))


def _machine_sums(featured: DataFrame, keys: list[str], means: dict[str, str]) -> DataFrame:
    """One row per machine: counts, sums, and the span of its failures."""
    first, last = F.min(_at_failure("timestamp")), F.max(_at_failure("timestamp"))
    timed = F.count(_at_failure("timestamp"))
    return featured.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("record_id").alias("records"),
        F.sum("failure_flag").alias("failures"),
        F.sum("high_risk_flag").alias("risky"),
        F.sum("operating_hours").alias("hours"),
        F.sum("downtime_hours").alias("down_hours"),
        F.sum("downtime_minutes").alias("down_minutes"),
        F.sum(_at_failure("downtime_hours")).alias("repair_hours"),
        F.coalesce(hours_between(first, last), F.lit(0.0)).alias("gap_hours"),
        F.greatest(timed - 1, F.lit(0)).alias("gaps"),
        *[F.sum(column).alias(f"sum_{label}") for label, column in means.items()],
        *[F.count(column).alias(f"n_{label}") for label, column in means.items()],
    )


def _mean(label: str) -> Column:
    return F.try_divide(F.sum(f"sum_{label}"), F.sum(f"n_{label}"))


def _mean_gap() -> Column:
    return F.coalesce(F.try_divide(F.sum("gap_hours"), F.sum("gaps")), F.lit(0.0))


def overall_kpis(featured: DataFrame) -> DataFrame:
    """One row of headline figures."""
    means = _MEANS | {"avg_days_since_maintenance": "days_since_last_maintenance"}
    hours, down, failures = F.sum("hours"), F.sum("down_hours"), F.sum("failures")

    def total(value: Column) -> Column:
        return F.coalesce(value, F.lit(0))

    return _machine_sums(featured, ["equipment_id"], means).agg(
        F.coalesce(F.try_divide(failures * 100.0, F.sum("rows")), F.lit(0.0)).alias("failure_rate_pct"),
        _mean_gap().alias("mtbf_hours"),
        F.coalesce(F.try_divide(F.sum("repair_hours"), failures), F.lit(0.0)).alias("mttr_hours"),
        total(F.sum("risky")).alias("high_risk_count"),
        F.count_if(F.col("risky") > 0).alias("high_risk_equipment_count"),
        _mean("avg_temperature").alias("avg_temperature_c"),
        _mean("avg_vibration").alias("avg_vibration_mm_s"),
        _mean("avg_health_index").alias("avg_health_index"),
        _mean("avg_failure_probability").alias("avg_failure_probability_pct"),
        total(down).alias("total_downtime_hours"),
        total(F.sum("down_minutes")).alias("total_downtime_minutes"),
        F.when(hours > 0, (hours - down) / hours * 100).otherwise(100.0).alias("availability_pct"),
        F.count("equipment_id").alias("total_equipment"),
        F.count_if(F.col("failures") > 0).alias("failed_equipment"),
        _mean("avg_days_since_maintenance").alias("avg_days_since_maintenance"),
    )


def risk_distribution_features(featured: DataFrame) -> DataFrame:
    """Records, machines, failures and scores per risk level, lowest risk first."""
    known = F.sum(F.when(F.col("risk_level").isNotNull(), F.col("record_count")))
    return (
        featured.groupBy(F.col("failure_risk_level").alias("risk_level"))
        .agg(
            F.count("record_id").alias("record_count"),
            F.count_distinct("equipment_id").alias("equipment_count"),
            F.sum("failure_flag").alias("failure_count"),
            F.sum("downtime_hours").alias("total_downtime_hours"),
            F.avg("failure_probability").alias("avg_failure_probability"),
            F.avg("health_index").alias("avg_health_index"),
        )
        .withColumn("percentage", F.try_divide(F.col("record_count") * 100.0, known.over(Window.partitionBy())))
        .orderBy(order_of(F.col("risk_level"), RISK_LEVELS))
    )


def downtime_per_equipment(featured: DataFrame) -> DataFrame:
    """Downtime and availability of each machine, most downtime first.

    Without meter hours, availability is 0 if there was downtime and NULL if not. Downtime per
    failure is 0 if there is neither, and NULL if there is downtime but no failure.
    """
    hours, down = F.col("total_operating_hours"), F.col("total_downtime_hours")
    availability = F.when((hours == 0) & (down > 0), 0.0).otherwise(
        clip(F.try_divide((hours - down) * 100.0, hours), 0, 100)
    )
    failures = F.col("failure_count")
    per_failure = F.when((failures == 0) & (down == 0), 0.0).otherwise(F.try_divide(down, failures))
    return (
        featured.groupBy("equipment_id", "equipment_type")
        .agg(
            F.sum("downtime_minutes").alias("total_downtime_minutes"),
            F.sum("downtime_hours").alias("total_downtime_hours"),
            F.sum("failure_flag").alias("failure_count"),
            F.max("operating_hours").alias("total_operating_hours"),
            F.avg("health_index").alias("avg_health_index"),
            F.avg("failure_probability").alias("avg_failure_probability"),
            F.sum("high_risk_flag").alias("high_risk_count"),
            F.count("record_id").alias("measurement_count"),
        )
        .withColumn("availability_pct", availability)
        .withColumn("avg_downtime_per_failure", per_failure)
        .orderBy(F.desc("total_downtime_minutes"), "equipment_id", "equipment_type")
    )


def equipment_health(featured: DataFrame) -> DataFrame:
    """Health of each machine with its maintenance priority, worst first."""
    machines = write_shared(
        featured.groupBy(*MACHINE).agg(
            F.avg("health_index").alias("avg_health_index"),
            F.avg("failure_probability").alias("avg_failure_probability"),
            F.avg("temperature_c").alias("avg_temperature"),
            F.max("temperature_c").alias("max_temperature"),
            F.avg("vibration_mm_s").alias("avg_vibration"),
            F.max("vibration_mm_s").alias("max_vibration"),
            F.avg("pressure_bar").alias("avg_pressure"),
            F.avg("efficiency_percent").alias("avg_efficiency"),
            F.max("operating_hours").alias("total_operating_hours"),
            F.avg("days_since_last_maintenance").alias("avg_days_since_maintenance"),
            F.sum("failure_flag").alias("failure_count"),
            F.sum("high_risk_flag").alias("high_risk_count"),
            F.count("record_id").alias("measurement_count"),
        )
    )
    ranked = average_rank(
        machines, "avg_health_index", 0, 100, into="maintenance_priority", spread=["equipment_id"]
    )
    return ranked.withColumn("health_status", band(F.col("avg_health_index"), CONDITION_BANDS)).orderBy(
        F.col("maintenance_priority").asc_nulls_last(), *MACHINE
    )


def failure_analysis(featured: DataFrame) -> DataFrame:
    """Failures by type, most frequent first; no rows if nothing failed."""
    failures = featured.where(failed())
    return (
        failures.groupBy("failure_type")
        .agg(
            F.count("record_id").alias("occurrence_count"),
            F.count_distinct("equipment_id").alias("affected_equipment"),
            F.sum("downtime_hours").alias("total_downtime_hours"),
            F.avg("downtime_hours").alias("avg_downtime_hours"),
            F.max("downtime_hours").alias("max_downtime_hours"),
            F.avg("temperature_c").alias("avg_temperature"),
            F.avg("vibration_mm_s").alias("avg_vibration"),
            F.avg("load_percent").alias("avg_load"),
            F.avg("operating_hours").alias("avg_operating_hours"),
        )
        .withColumn(
            "percentage",
            F.try_divide(
                F.col("occurrence_count") * 100.0, F.sum("occurrence_count").over(Window.partitionBy())
            ),
        )
        .orderBy(F.desc("occurrence_count"), "failure_type")
    )


def monthly_trends(featured: DataFrame) -> DataFrame:
    """Figures per month of the reading time; readings without a time do not count."""
    return (
        featured.where(F.col("year").isNotNull())
        .groupBy("year", "month")
        .agg(
            F.sum("failure_flag").alias("failure_count"),
            F.count("record_id").alias("total_records"),
            F.avg("health_index").alias("avg_health_index"),
            F.avg("failure_probability").alias("avg_failure_probability"),
            F.avg("temperature_c").alias("avg_temperature"),
            F.avg("vibration_mm_s").alias("avg_vibration"),
            F.avg("efficiency_percent").alias("avg_efficiency"),
            F.sum("downtime_hours").alias("total_downtime_hours"),
            F.sum("high_risk_flag").alias("high_risk_count"),
            F.sum("energy_consumption_kwh").alias("total_energy_consumption"),
        )
        .withColumn(
            "failure_rate_pct", F.try_divide(F.col("failure_count") * 100.0, F.col("total_records"))
        )
        .orderBy("year", "month")
    )


def equipment_type_kpis(featured: DataFrame) -> DataFrame:
    """Figures per equipment type, highest failure rate first."""
    means = _MEANS | {"avg_efficiency": "efficiency_percent"}
    rate = F.try_divide(F.sum("failures"), F.sum("rows"))
    return (
        _machine_sums(featured, ["equipment_type", "equipment_id"], means)
        .groupBy("equipment_type")
        .agg(
            F.count("equipment_id").alias("equipment_count"),
            F.sum("failures").alias("failure_count"),
            rate.alias("failure_rate"),
            *[_mean(label).alias(label) for label in means],
            F.sum("down_hours").alias("total_downtime_hours"),
            F.sum("hours").alias("total_operating_hours"),
            F.sum("risky").alias("high_risk_count"),
            F.sum("records").alias("measurement_count"),
            (rate * 100).alias("failure_rate_pct"),
            _mean_gap().alias("mtbf_hours"),
        )
        .orderBy(F.desc("failure_rate_pct"), "equipment_type")
    )


def predictive_alerts(featured: DataFrame) -> DataFrame:
    """Machines that need attention, most severe first; no rows if there are none."""
    health, chance = F.col("current_health_index"), F.col("max_failure_probability")
    severity = (
        F.when((health < CRITICAL_HEALTH) | (chance > CRITICAL_PROBABILITY), SEVERITIES[0])
        .when((health < SERIOUS_HEALTH) | (chance > SERIOUS_PROBABILITY), SEVERITIES[1])
        .otherwise(SEVERITIES[2])
    )
    urgent = (
        (F.col("high_risk_flag") == 1)
        | (F.col("health_index") < ALERT_HEALTH)
        | (F.col("failure_probability") > ALERT_PROBABILITY)
    )
    return (
        featured.where(urgent)
        .groupBy(*MACHINE)
        .agg(
            F.min("health_index").alias("current_health_index"),
            F.max("failure_probability").alias("max_failure_probability"),
            F.max("temperature_c").alias("max_temperature"),
            F.max("vibration_mm_s").alias("max_vibration"),
            F.max("days_since_last_maintenance").alias("days_since_maintenance"),
            _most_frequent_level().alias("risk_level"),
            F.max("timestamp").alias("last_reading"),
        )
        .withColumn("alert_severity", severity)
        .orderBy(
            order_of(F.col("alert_severity"), SEVERITIES),
            F.col("current_health_index").asc_nulls_last(),
            *MACHINE,
        )
    )


def _most_frequent_level() -> Column:
    """Most frequent of the four risk levels, ties to the first in the alphabet; NULL without a known level.

    Four counters stay in the hash aggregation; `mode` would switch to an object aggregation.
    """
    counts = [
        F.struct(
            F.count_if(F.col("failure_risk_level") == level).alias("n"),
            F.lit(-position).alias("place"),
            F.lit(level).alias("level"),
        )
        for position, level in enumerate(sorted(RISK_LEVELS))
    ]
    most = F.greatest(*counts)
    return F.when(most["n"] > 0, most["level"])


# --- the printed report ---------------------------------------------------------------------


def most_downtime(featured: DataFrame) -> DataFrame:
    return downtime_per_equipment(featured).limit(SHOWN_DOWNTIME)


def least_healthy(featured: DataFrame) -> DataFrame:
    return equipment_health(featured).limit(SHOWN_HEALTH)


def latest_months(featured: DataFrame) -> DataFrame:
    newest = monthly_trends(featured).orderBy(F.desc("year"), F.desc("month")).limit(SHOWN_MONTHS)
    return newest.orderBy("year", "month")


def first_alerts(featured: DataFrame) -> DataFrame:
    return predictive_alerts(featured).limit(SHOWN_ALERTS)


REPORT = {
    "overall_kpis": overall_kpis,
    "risk_distribution": risk_distribution_features,
    "most_downtime": most_downtime,
    "least_healthy": least_healthy,
    "failure_analysis": failure_analysis,
    "equipment_type_kpis": equipment_type_kpis,
    "latest_months": latest_months,
    "first_alerts": first_alerts,
}
