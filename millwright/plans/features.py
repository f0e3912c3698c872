"""Scores derived from clean readings: anomalies, health, failure probability, bands."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import band, clip
from ..operators.lookup import join_written
from ..operators.shared_table import write_shared
from ..schema import CONDITION_BANDS, RISK_WEIGHT, URGENCY_BANDS

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
ANOMALY_DEVIATIONS = 2
WEAR_SHARES = {
    "temp_normalized": 0.25,
    "vibration_normalized": 0.30,
    "efficiency_normalized": 0.25,
    "load_normalized": 0.20,
}
WEAR_SHARE, RISK_SHARE, MAINTENANCE_SHARE = 0.5, 0.3, 0.2
HIGH_RISK_LEVELS = ["High", "Critical"]
HIGH_PROBABILITY = 70
LOW_HEALTH = 40

_SENSORS = {"temp": "temperature_c", "vibration": "vibration_mm_s"}


def add_features(clean: DataFrame) -> DataFrame:
    """Add the derived columns. Write the result before filtering on them (see `job.prepare`).

    Means and deviations per equipment type, and minima and maxima over all readings, come from one
    grouped pass; that small table is joined back. A window over equipment_type would shuffle and
    sort all readings into a handful of tasks.
    """
    stats = write_shared(_statistics(clean))
    rows = join_written(clean, stats, ["equipment_type"], spread=["record_id"])
    for label, sensor in _SENSORS.items():
        rows = rows.withColumn(f"{label}_zscore", _zscore(label, sensor))
    rows = rows.withColumns(
        {
            **{f"{label}_anomaly": _flag(F.abs(f"{label}_zscore") > ANOMALY_DEVIATIONS) for label in _SENSORS},
            **{f"{label}_normalized": _scaled(label, sensor) for label, sensor in _SENSORS.items()},
            "efficiency_normalized": 1 - F.col("efficiency_percent") / 100,
            "load_normalized": F.col("load_percent") / 100,
            "risk_numeric": _risk_weight(),
            "downtime_hours": F.col("downtime_minutes") / 60,
        }
    )
    wear = sum((F.col(name) * share for name, share in WEAR_SHARES.items()), F.lit(0.0))
    # Compute, then bound, in two steps: the sum is computed once.
    rows = rows.withColumn("health_index", 100 - 100 * wear)
    rows = rows.withColumn("health_index", clip(F.col("health_index"), 0, 100))

    wait = F.try_divide("days_since_last_maintenance", F.col("whole.max_days"))
    chance = (
        (100 - F.col("health_index")) / 100 * WEAR_SHARE
        + F.col("risk_numeric") * RISK_SHARE
        + wait * MAINTENANCE_SHARE
    )
    rows = rows.withColumn("failure_probability", 100 * chance)
    rows = rows.withColumn("failure_probability", clip(F.col("failure_probability"), 0, 100))
    risky = (
        F.col("failure_risk_level").isin(HIGH_RISK_LEVELS)
        | F.coalesce(F.col("failure_probability") > HIGH_PROBABILITY, F.lit(False))
        | F.coalesce(F.col("health_index") < LOW_HEALTH, F.lit(False))
    )
    rows = rows.withColumns(
        {
            "maintenance_urgency": band(F.col("failure_probability"), URGENCY_BANDS),
            "high_risk_flag": _flag(risky),
            "operating_condition": band(F.col("health_index"), CONDITION_BANDS),
        }
    )
    return rows.drop("whole", *[f"{part}_{label}" for label in _SENSORS for part in ("mean", "std")])


def _statistics(clean: DataFrame) -> DataFrame:
    """Per type: mean and deviation of each sensor; the same on each row: bounds of all readings."""
    of_type, of_all = [], []
    for label, sensor in _SENSORS.items():
        of_type += [F.avg(sensor).alias(f"mean_{label}"), F.stddev_samp(sensor).alias(f"std_{label}")]
        of_type += [F.min(sensor).alias(f"min_{label}"), F.max(sensor).alias(f"max_{label}")]
        of_all += [F.min(f"min_{label}").alias(f"min_{label}"), F.max(f"max_{label}").alias(f"max_{label}")]
    of_type.append(F.max("days_since_last_maintenance").alias("max_days"))
    of_all.append(F.max("max_days").alias("max_days"))

    types = write_shared(clean.groupBy("equipment_type").agg(*of_type))
    whole = types.agg(F.struct(*of_all)).scalar()
    kept = [f"{part}_{label}" for label in _SENSORS for part in ("mean", "std")]
    return types.select("equipment_type", *kept, whole.alias("whole"))


def _zscore(label: str, sensor: str) -> Column:
    """Deviations from the mean of the type; 0 where the type has no deviation (one reading)."""
    std = F.col(f"std_{label}")
    return F.when(std > 0, (F.col(sensor) - F.col(f"mean_{label}")) / std).otherwise(0.0)


def _scaled(label: str, sensor: str) -> Column:
    low, high = F.col(f"whole.min_{label}"), F.col(f"whole.max_{label}")
    return F.try_divide(F.col(sensor) - low, high - low)


def _risk_weight() -> Column:
    weight = F.lit(None).cast("double")
    for level, points in RISK_WEIGHT.items():
        weight = F.when(F.col("failure_risk_level") == level, points).otherwise(weight)
    return weight


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)
