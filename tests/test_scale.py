"""Hot keys, both ways of joining, and the plans large tables depend on."""

import random
from datetime import datetime, timedelta
from statistics import median

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millwright import catalog
from millwright.operators import lookup, medians
from millwright.operators.dedup import first_per_key
from millwright.operators.intervals import previous_pairs
from millwright.operators.ranking import average_rank
from millwright.operators.shared_table import shared_folder, write_shared
from millwright.plans import maintenance, quality, sensors

START = datetime(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def readings(spark, sf_dir):
    return entry.prepare_readings(spark, sf_dir)


@pytest.fixture(scope="module")
def skewed(readings):
    """A third of all readings on one machine of one type."""
    hot = F.col("record_id") % 3 == 0
    return write_shared(
        readings.withColumn("equipment_id", F.when(hot, "EQ-HOT").otherwise(F.col("equipment_id")))
        .withColumn("equipment_type", F.when(hot, "Pump").otherwise(F.col("equipment_type")))
    )


# --- joins ------------------------------------------------------------------------------------


@pytest.mark.parametrize("measure", [quality.vibration_outliers, sensors.vib_alerts])
def test_large_lookup_is_salted_and_equal(measure, skewed, monkeypatch):
    monkeypatch.setattr(sensors, "write_shared", lambda df: df)
    small = measure(skewed)
    assert "BroadcastHashJoin" in plan(small)
    monkeypatch.setattr(lookup, "fits_broadcast", lambda *_: False)
    large = measure(skewed)
    assert "_salt" in plan(large) and "Broadcast" not in plan(large)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_size_is_measured(spark):
    table = write_shared(spark.range(50).withColumn("text", F.lit("x" * 100)))
    assert lookup.fits_broadcast(table)
    assert not lookup.fits_broadcast(table, max_rows=49)


def test_wide_text_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_TEXT_BYTES", 4000)
    assert not lookup.fits_broadcast(write_shared(spark.range(50).withColumn("text", F.lit("x" * 100))))


def test_left_lookup_keeps_unmatched_rows(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, key string")
    table = write_shared(spark.createDataFrame([("a", 10)], "key string, value int"))
    for rows in (100, 0):
        joined = lookup.join_written(facts, table, ["key"], ["id"], "left", max_rows=rows)
        assert sorted((r["id"], r["value"]) for r in joined.collect()) == [(1, 10), (2, None), (3, None)]


@pytest.mark.parametrize("name", entry.queries())
def test_no_plan_pairs_all_rows(name, spark, sf_dir):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


# --- medians ----------------------------------------------------------------------------------


def _values(spark, groups: dict[str, list]):
    rows = [("s", member, value, 1) for member, values in groups.items() for value in values]
    return _written(spark, rows)


def _written(spark, rows: list[tuple]):
    df = spark.createDataFrame(rows, "series string, member string, value double, n bigint")
    return write_shared(df.withColumn("id", F.monotonically_increasing_id()))


def _medians(values, few: bool) -> dict:
    return {row["member"]: row["median"] for row in medians.group_medians(values, few).collect()}


@pytest.mark.parametrize("few, fits", [(True, True), (False, True), (False, False)])
def test_medians_of_a_hot_group(spark, few, fits, monkeypatch):
    monkeypatch.setattr(lookup, "fits_broadcast", lambda *_: fits)
    rng = random.Random(7)
    groups = {
        "hot": [rng.gauss(50, 20) for _ in range(3000)] + [50.0] * 1500,
        "negative": [-rng.expovariate(0.01) for _ in range(100)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 12) for _ in range(101)],
        "equal": [3.5] * 40,
        "one": [-7.25],
        "gaps": [None, 1.0, None, 2.0],
        "nothing": [None, None],
    }
    expected = {
        member: median(v for v in values if v is not None)
        for member, values in groups.items() if any(v is not None for v in values)
    }
    assert _medians(_values(spark, groups), few) == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(
        st.sampled_from("abc"),
        st.lists(st.floats(-1e6, 1e6, allow_nan=False) | st.integers(-3, 3).map(float), min_size=1, max_size=30),
        min_size=1,
    )
)
def test_narrowing_equals_counting(spark, groups):
    values = _values(spark, groups)
    assert _medians(values, False) == _medians(values, True)


def test_medians_weigh_rows(spark):
    rows = [("s", "g", 1.0, 5), ("s", "g", 2.0, 1), ("s", "g", 9.0, 6)]
    values = _written(spark, rows)
    assert _medians(values, True) == _medians(values, False) == {"g": 5.5}


# --- order-dependent operators ------------------------------------------------------------------


def test_pairs_of_a_hot_machine(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        machine = rng.choice(["hot", "hot", "hot", "a", "b", None])
        time = None if rng.random() < 0.1 else START + timedelta(minutes=rng.randrange(60 * 24 * 3))
        rows.append((machine, time, i * 700_001, float(i)))
    df = spark.createDataFrame(rows, "machine string, time timestamp_ntz, id bigint, value double")
    pairs = previous_pairs(df, "machine", "time", "id", ["id", "value"])
    found = {r["current"]["id"]: r["previous"]["id"] for r in pairs.collect()}

    expected = {}
    for machine in ["hot", "a", "b", None]:
        mine = [r for r in rows if r[0] == machine]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or START, r[2]))
        expected |= {later[2]: earlier[2] for earlier, later in zip(mine, mine[1:])}
    assert found == expected


def test_pairs_shuffle_slots_not_machines(readings):
    text = plan(catalog.ON_READINGS["mtbf_by_equipment"](readings))
    assert "hashpartitioning(equipment_id" in text and "slot" in text


def test_one_row_per_id_is_cut_before_the_shuffle(spark, readings):
    text = plan(first_per_key(readings, "record_id", ["timestamp"]))
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.rindex("Partial")


def test_latest_reading_is_cut_before_the_shuffle(readings):
    text = plan(catalog.ON_READINGS["failure_probability_current"](readings))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("fits", [True, False])
def test_rank_equals_pandas(spark, fits, monkeypatch):
    monkeypatch.setattr(lookup, "fits_broadcast", lambda *_: fits)
    rng = random.Random(5)
    values = [rng.choice([0.0, 100.0, 50.0, None, 33.333]) if rng.random() < 0.5 else rng.uniform(0, 100) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, value double")
    ranked = average_rank(df, "value", 0, 100, into="rank", spread=["id"]).orderBy("id").collect()
    expected = pd.Series(values, dtype=float).rank()
    assert [r["rank"] for r in ranked] == [None if pd.isna(e) else e for e in expected]


# --- scans --------------------------------------------------------------------------------------


def test_filters_and_columns_reach_the_scan(readings):
    text = readings.sparkSession._jvm.PythonSQLUtils.explainString(
        catalog.ON_READINGS["mttr_by_type"](readings)._jdf.queryExecution(), "formatted"
    )
    assert "EqualTo(failure_flag,1)" in text and "IsNotNull(downtime_minutes)" in text
    assert "ReadSchema: struct<equipment_type:string,failure_flag:int,downtime_minutes:double>" in text


def test_dashboard_filters_reach_the_stored_features(spark, sf_dir):
    view = maintenance.filtered_view(
        entry.prepare_features(spark, sf_dir), "EQ-00001", START, START + timedelta(days=90), "Preventive", "Fair"
    )
    text = spark._jvm.PythonSQLUtils.explainString(view.select("health_index")._jdf.queryExecution(), "formatted")
    for column in ("equipment_id", "maintenance_type", "operating_condition"):
        assert f"EqualTo({column}," in text
    assert "GreaterThanOrEqual(timestamp,2024-01-01T00:00)" in text
    assert "LessThan(timestamp,2024-03-31T00:00)" in text


@pytest.mark.parametrize("name", ["dashboard_executive", "dashboard_by_type"])
def test_counting_machines_does_not_expand_rows(name, readings):
    assert "Expand" not in plan(catalog.ON_READINGS[name](readings))


def test_intermediate_tables_go_to_the_checkpoint_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_folder(spark) == named
    assert f"{shared_folder(spark)}/millwright-" in write_shared(spark.range(3)).inputFiles()[0]
