"""Health indices computed straight from the readings (higher is healthier)."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import failure_rate, first_by, two_decimals

# ---------------------------------------------------------------------------
# Wear scores run from 0 (good) to 100 (bad).
# ---------------------------------------------------------------------------
TEMPERATURE_SCORE = (50, 100, 2)  # below / above / slope
VIBRATION_SCORE = (2, 20, 5.56)
DEFAULT_EFFICIENCY = 80
RISK_SCORE = {"Low": 0, "Medium": 50, "High": 100}
OTHER_RISK_SCORE = 25
STATUS_FROM = [(80, "Excellent"), (60, "Good"), (40, "Fair"), (20, "Poor")]
LOWEST_STATUS = "Critical"


def _ramp(name: str, start: float, end: float, slope: float) -> Column:
    value = F.col(name)
    rising = (value - F.lit(start)) * F.lit(slope)
    return F.when(value <= start, 0.0).when(value >= end, 100.0).otherwise(rising)


def _risk_score() -> Column:
    score = F.lit(OTHER_RISK_SCORE)
    for level, points in RISK_SCORE.items():
        score = F.when(F.col("failure_risk_level") == level, points).otherwise(score)
    return score


def _status(index: Column) -> Column:
    status = F.lit(LOWEST_STATUS)
    for lowest, label in reversed(STATUS_FROM):
        status = F.when(index >= lowest, label).otherwise(status)
    return status


def health_index_by_equipment(readings: DataFrame) -> DataFrame:
    """100 minus the mean of four wear scores: temperature, vibration, efficiency, risk."""
    efficiency = F.coalesce("efficiency_percent", F.lit(float(DEFAULT_EFFICIENCY)))
    scores = {
        "avg_temp_score": _ramp("temperature_c", *TEMPERATURE_SCORE),
        "avg_vib_score": _ramp("vibration_mm_s", *VIBRATION_SCORE),
        "avg_eff_score": 100 - efficiency,
        "avg_risk_score": _risk_score(),
    }
    machines = (
        readings.where(F.col("temperature_c").isNotNull() & F.col("vibration_mm_s").isNotNull())
        .groupBy("equipment_id", "equipment_type")
        .agg(
            *[F.avg(score).alias(label) for label, score in scores.items()],
            F.sum("failure_flag").alias("failure_count"),
        )
    )
    index = 100 - reduce(add, [F.col(label) for label in scores]) / len(scores)
    return (
        machines.withColumn("index", index)
        .select(
            "equipment_id",
            "equipment_type",
            *scores,
            two_decimals(F.col("index")).alias("health_index"),
            _status(F.col("index")).alias("health_status"),
            "failure_count",
        )
        .orderBy(first_by(F.desc("health_index"), ["equipment_id", "equipment_type"]))
    )


def health_index_by_type(readings: DataFrame) -> DataFrame:
    """Mean efficiency less half the mean temperature and twice the mean vibration."""
    used = ["efficiency_percent", "temperature_c", "vibration_mm_s"]
    index = F.col("avg_efficiency") - F.col("avg_temp") / 2 - F.col("avg_vibration") * 2
    return (
        readings.dropna(subset=used)
        .groupBy("equipment_type")
        .agg(
            F.count_distinct("equipment_id").alias("equipment_count"),
            F.avg("efficiency_percent").alias("avg_efficiency"),
            F.avg("temperature_c").alias("avg_temp"),
            F.avg("vibration_mm_s").alias("avg_vibration"),
            failure_rate().alias("failure_rate"),
        )
        .withColumn("health_index", two_decimals(index))
        .orderBy(F.desc("health_index"))
    )
