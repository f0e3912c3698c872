"""Measures from stored day states against the same measures of the readings."""

import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millwright import catalog
from millwright.operators.moments import States, states
from millwright.operators.shared_table import stored_tables, write_shared
from millwright.plans import day_states
from millwright.plans.maintenance import filtered_view

from . import compare


@pytest.fixture(scope="module")
def readings(spark, sf_dir):
    """Some machines, times and dates unknown; a third of the readings on one machine."""
    plain, record = entry.prepare_readings(spark, sf_dir), F.col("record_id")
    return write_shared(
        plain.withColumns(
            {
                "equipment_id": F.when(record % 3 == 0, "EQ-HOT").when(record % 11 != 0, F.col("equipment_id")),
                "timestamp": F.when(record % 7 != 0, F.col("timestamp")),
                "date": F.when(record % 17 != 0, F.col("date")),
                "temperature_c": F.when(record % 5 != 0, F.col("temperature_c") + 1e6),  # a mean far above the spread
            }
        )
    )


PERIODS = [
    {}, {"start": datetime(2024, 2, 11), "end": datetime(2024, 6, 3)}, {"end": datetime(2024, 3, 1), "equipment_id": "EQ-HOT"},
    {"start": datetime(2031, 1, 1)},
]


@pytest.mark.parametrize("period", PERIODS)
def test_all_measures_of_a_period(readings, period):
    with stored_tables():
        stored = write_shared(day_states.day_states(readings))
        found = day_states.measures(day_states.of_period(stored, **period))
        rows = filtered_view(readings, **period)
        for name, table in found.items():
            expected = entry._rounded(catalog.ON_READINGS[name](rows))
            assert compare.actual(entry._rounded(table)) == compare.actual(expected), name


def test_one_scan_of_the_readings_makes_all_tables(readings):
    with stored_tables():
        tables = day_states.summaries(readings)
        assert set(tables) == set(day_states.MEASURES)
        sources = set(readings.inputFiles())
        assert all(not sources & set(table.inputFiles()) for table in tables.values())


def test_states_need_whole_days(readings):
    with pytest.raises(ValueError):
        day_states.of_period(day_states.day_states(readings), start=datetime(2024, 1, 1, 6))


def test_more_keys_allow_more_filters(readings):
    stored = day_states.day_states(readings, ["maintenance_type"])
    some = day_states.of_period(stored, maintenance_type="Preventive")
    expected = readings.where("maintenance_type = 'Preventive'").count()
    assert some.agg(F.sum("rows")).first()[0] == expected


def test_merged_spread_equals_the_plain_one(spark):
    values = [1e9 + 0.5, 1e9 + 2.25, None, 1e9 + 2.25, 1e9 - 3.0, None, 1e9 + 40.0]
    df = spark.createDataFrame([(at % 3, value) for at, value in enumerate(values)], "part int, v double")
    stored = states(df, ["part"], ["v"])
    merged = States.of(stored)
    row = stored.agg(
        merged.deviation("v").alias("dev"), merged.mean("v").alias("mean"), merged.least("v").alias("least"),
        merged.most("v").alias("most"), merged.count("v").alias("n"), merged.rows().alias("all"),
    ).first()
    known = [v for v in values if v is not None]
    assert row.dev == pytest.approx(statistics.stdev(known), rel=1e-9)
    assert (row.mean, row.least, row.most, row.n, row.all) == (statistics.mean(known), min(known), max(known), 5, 7)
    one = states(df.where("part = 2 AND v > 1e9 + 2"), ["part"], ["v"])
    assert one.agg(States.of(one).deviation("v")).first()[0] is None
    none = one.limit(0)
    assert tuple(none.agg(States.of(none).count("v"), States.of(none).deviation("v")).first()) == (0, None)
