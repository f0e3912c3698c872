"""Measures of any period from stored states, one for each machine and day, in place of the readings.

One scan makes the states of all measures below. They are smaller than the readings by the number of readings a machine has a
day. Each measure is the same function as on readings.
"""

from collections.abc import Callable
from datetime import datetime, time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.moments import States, states
from ..operators.shared_table import write_shared
from . import downtime, reliability, sensors
from .maintenance import filtered_view

KEYS = [
    "equipment_id", "equipment_type", "plant_area", "manufacturer", "shift", "failure_flag", "failure_type", "date",
]
MEASURED = ["temperature_c", "vibration_mm_s", "downtime_minutes", "operating_hours"]

MEASURES: dict[str, Callable[..., DataFrame]] = {
    measure.__name__: measure
    for measure in (
        reliability.failure_rate_overall, reliability.failure_rate_by_type, reliability.failure_rate_by_equipment,
        reliability.failure_rate_monthly, reliability.failure_rate_by_shift, reliability.mtbf_by_type, reliability.mtbf_by_area,
        downtime.mttr_by_type, downtime.mttr_by_equipment, downtime.mttr_by_failure_type, downtime.mttr_monthly,
        sensors.temp_overall, sensors.temp_by_type, sensors.temp_by_equipment, sensors.temp_daily_trend,
        sensors.temp_normal_vs_failure, sensors.vib_overall, sensors.vib_by_type, sensors.vib_by_equipment,
        sensors.vib_normal_vs_failure, downtime.downtime_overall, downtime.downtime_by_type, downtime.downtime_by_area,
        downtime.downtime_monthly, downtime.downtime_by_failure_type,
    )
}


def day_states(readings: DataFrame, more: list[str] | None = None) -> DataFrame:
    """States of all measured columns by machine and day; `timestamp` is the start of the day, NULL where the time is not known.

    `more` adds columns of the readings to the keys, for filters on them.
    """
    day = F.to_date("timestamp").cast("timestamp_ntz").alias("timestamp")
    return states(readings, [*KEYS, *(more or []), day], MEASURED)


def of_period(stored: DataFrame, start: datetime | None = None, end: datetime | None = None, **filters: str) -> DataFrame:
    """The states of whole days from `start` to before `end`, of a machine or of other columns that are keys; see `filtered_view`."""
    for moment in (start, end):
        if moment is not None and moment.time() != time.min:
            raise ValueError(f"{moment} is within a day; states are of whole days")
    return filtered_view(stored, start=start, end=end, **filters)


def measures(stored: DataFrame) -> dict[str, DataFrame]:
    """Every measure of these states. The means they are centred at are one row on the driver."""
    values = States.of(stored)
    return {name: measure(stored, values=values) for name, measure in MEASURES.items()}


def summaries(readings: DataFrame) -> dict[str, DataFrame]:
    """Every measure of MEASURES, from one scan of the readings."""
    return measures(write_shared(day_states(readings)))
