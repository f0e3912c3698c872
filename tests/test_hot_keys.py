"""All measures and reports on readings where one machine, type and id hold a third of the rows.

Some machines and times are unknown too. The SQL is the same as for the plain readings.
"""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millwright import catalog
from millwright.operators.shared_table import write_shared
from millwright.plans import job
from millwright.sources.event_readings import as_raw
from oracles import features_sql, inputs, readings_sql

from . import compare


@pytest.fixture(scope="module")
def hot(spark, sf_dir):
    readings = entry.prepare_readings(spark, sf_dir)
    record, third = F.col("record_id"), F.col("record_id") % 3 == 0
    return write_shared(
        readings.withColumns(
            {
                "equipment_id": F.when(third, "EQ-HOT").when(record % 11 != 0, F.col("equipment_id")),
                "equipment_type": F.when(third, "Pump").when(record % 13 != 0, F.col("equipment_type")),
                "timestamp": F.when(record % 7 != 0, F.col("timestamp")),
                "date": F.when(record % 17 != 0, F.col("date")),
            }
        )
    )


@pytest.fixture(scope="module")
def featured(hot):
    return job.prepare(as_raw(hot))


def _check(con, df, sql: str, table) -> None:
    files = "', '".join(path.removeprefix("file://") for path in table.inputFiles())
    stored = f"readings AS (SELECT * FROM read_parquet(['{files}']))"
    assert inputs.READINGS in sql
    types, rows = compare.actual(entry._rounded(df))
    expected_types, expected_rows = compare.expected(con, sql.replace(inputs.READINGS, stored))
    assert types == expected_types
    assert rows == expected_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.database(sf_dir)


@pytest.mark.parametrize("name", catalog.ON_READINGS)
def test_measure(name, hot, con):
    sql = inputs.on_readings(readings_sql.ON_READINGS[name])
    _check(con, catalog.ON_READINGS[name](hot), sql, hot)


@pytest.mark.parametrize("name", catalog.ON_FEATURES)
def test_report(name, hot, featured, con):
    _check(con, catalog.ON_FEATURES[name](featured), features_sql.ON_EVENTS[name], hot)


def test_features(hot, featured, con):
    columns = ["record_id", *features_sql.FEATURE_STEPS["featured_readings"]]
    _check(con, featured.select(*columns), features_sql.ON_EVENTS["featured_readings"], hot)


def test_one_id_on_a_third_of_all_rows(hot):
    raw = as_raw(hot)
    repeated = raw.withColumn(
        "record_id", F.when(F.col("record_id").cast("bigint") % 3 != 0, F.col("record_id"))
    )
    staged = job.clean_readings(repeated)
    assert staged.count() == raw.where("cast(record_id AS bigint) % 3 != 0").select("record_id").distinct().count() + 1
