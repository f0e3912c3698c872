"""Summary rows for a dashboard.

Both summaries count machines while they average readings. Readings are therefore first reduced to
one row per machine (partial sums and counts), then to the summary: one machine is one row, so
counting machines needs no DISTINCT, and no row is expanded once per DISTINCT.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import failed, high_risk, percent, ratio, two_decimals


def _machines(readings: DataFrame, keys: list[str]) -> DataFrame:
    down = F.when(failed(), F.col("downtime_minutes"))
    sums = {
        "hours": F.col("operating_hours"),
        "energy": F.col("energy_consumption_kwh"),
        "repair": down,
        "down": F.when(failed(), F.col("downtime_minutes")).otherwise(0.0),
        "temp": F.col("temperature_c"),
        "vib": F.col("vibration_mm_s"),
        "eff": F.col("efficiency_percent"),
    }
    counted = ["repair", "temp", "vib", "eff"]
    return readings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(failed(), 1).otherwise(0)).alias("failures"),
        F.count_if(high_risk()).alias("risky"),
        *[F.sum(value).alias(name) for name, value in sums.items()],
        *[F.count(sums[name]).alias(f"{name}_n") for name in counted],
    )


def _mean(name: str) -> Column:
    return ratio(F.sum(name), F.sum(f"{name}_n"))


def _machines_at_risk() -> Column:
    return F.count(F.when(F.col("risky") > 0, F.col("equipment_id")))


def dashboard_executive(readings: DataFrame) -> DataFrame:
    totals = _machines(readings, ["equipment_id"]).agg(
        F.count("equipment_id").alias("total_equipment"),
        percent(F.sum("failures"), F.sum("n")).alias("failure_rate_pct"),
        two_decimals(ratio(F.sum("hours"), F.sum("failures"))).alias("mtbf_hours"),
        two_decimals(_mean("repair") / 60.0).alias("mttr_hours"),
        _machines_at_risk().alias("high_risk_equipment"),
        percent(F.sum("risky"), F.sum("n")).alias("high_risk_pct"),
        two_decimals(_mean("temp")).alias("avg_temperature"),
        two_decimals(_mean("vib")).alias("avg_vibration"),
        two_decimals(_mean("eff")).alias("avg_efficiency"),
        two_decimals(F.sum("down") / 60.0).alias("total_downtime_hours"),
        F.sum("failures").alias("total_failures"),
        two_decimals(F.sum("energy")).alias("total_energy_consumption"),
    )
    return totals.select(F.lit("Overall Performance").alias("metric_category"), "*")


def dashboard_by_type(readings: DataFrame) -> DataFrame:
    typed = readings.where(F.col("equipment_type").isNotNull())
    return (
        _machines(typed, ["equipment_type", "equipment_id"])
        .groupBy("equipment_type")
        .agg(
            F.count("equipment_id").alias("equipment_count"),
            percent(F.sum("failures"), F.sum("n")).alias("failure_rate_pct"),
            two_decimals(_mean("repair")).alias("avg_mttr_minutes"),
            _machines_at_risk().alias("high_risk_count"),
            two_decimals(_mean("temp")).alias("avg_temp"),
            two_decimals(_mean("vib")).alias("avg_vibration"),
            two_decimals(F.sum("down") / 60.0).alias("total_downtime_hours"),
        )
        .orderBy(F.desc("failure_rate_pct"))
    )
