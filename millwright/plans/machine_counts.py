"""Numbers of machines at risk, of any period, about, from one stored sketch for each day, type, area and risk level."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sketches import LG_K, SKETCHED, machine_sketches
from . import risk

KEYS = ["equipment_type", "plant_area", "failure_risk_level", "date"]

MEASURES = {
    measure.__name__: measure
    for measure in (
        risk.high_risk_count, risk.high_risk_by_type_area, risk.high_risk_monthly, risk.risk_distribution,
        risk.risk_distribution_by_type, risk.risk_distribution_by_area, risk.risk_trend_monthly,
    )
}


def day_sketches(readings: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """To be stored once; `timestamp` is the start of the day, so `of_period` of the day states filters these, too."""
    day = F.to_date("timestamp").cast("timestamp_ntz").alias("timestamp")
    return machine_sketches(readings, [*KEYS, day], lg_k)


def about(stored: DataFrame, name: str) -> DataFrame:
    """The measure `name` from stored sketches: records and shares are exact, machines are off by `standard_error` as a rule."""
    return MEASURES[name](stored, machines=SKETCHED)
