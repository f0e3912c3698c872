"""Machines counted by merged sketches against exact counts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millwright import catalog
from millwright.operators.shared_table import stored_tables, write_shared
from millwright.operators.sketches import SKETCHED, machine_sketches, standard_error
from millwright.plans import day_states, machine_counts
from millwright.plans.maintenance import filtered_view


def _rows(df, machines: str) -> dict:
    return {tuple(row[name] for name in df.columns if name != machines): row[machines] for row in df.collect()}


@pytest.mark.parametrize("period", [{}, {"start": datetime(2024, 2, 1), "end": datetime(2024, 7, 4)}, {"start": datetime(2040, 1, 1)}])
def test_measures_from_sketches(spark, sf_dir, period):
    readings = entry.prepare_readings(spark, sf_dir)
    with stored_tables():
        stored = write_shared(machine_counts.day_sketches(readings))
        for name in machine_counts.MEASURES:
            about = machine_counts.about(day_states.of_period(stored, **period), name)
            exact = catalog.ON_READINGS[name](filtered_view(readings, **period))
            assert about.dtypes == exact.dtypes
            machines = next(column for column in exact.columns if "equipment" in column and column not in ("equipment_type",))
            found, expected = _rows(about, machines), _rows(exact, machines)
            assert found.keys() == expected.keys()
            assert all(abs(found[key] - expected[key]) <= max(1, 4 * standard_error() * expected[key]) for key in expected), name


def test_error_of_many_machines(spark):
    rows = spark.range(400_000).select(F.concat(F.lit("EQ-"), F.col("id") % 150_000).alias("equipment_id"), (F.col("id") % 30).alias("day"))
    for lg_k in (10, 14):
        stored = machine_sketches(rows, ["day"], lg_k)
        found = stored.agg(SKETCHED.distinct().alias("n"), SKETCHED.records().alias("rows")).first()
        assert abs(found.n / 150_000 - 1) <= 4 * standard_error(lg_k)
        assert found.rows == 400_000
