from datetime import date, datetime
from statistics import median

import pytest
from pyspark.sql import functions as F

from millwright.plans.cleaning import clean_readings, drop_repeated_ids, gap_values, stage
from millwright.plans import cleaning
from millwright.plans.quality import dedup_report, null_profile

from .frames import column, raw, typed


def test_bad_cells_become_null_and_are_filled(spark):
    cells = ["abc", "", "12,5", "1d", "2F", "0x1p3", "nan", None]
    rows = raw(spark, [{"temperature_c": t} for t in ["10", "20", " 30 ", *cells]])
    staged = stage(rows)
    assert column(staged, "temperature_c")[:3] == [10.0, 20.0, 30.0]
    assert column(staged, "temperature_c")[3:] == [None] * len(cells)
    assert column(clean_readings(rows), "temperature_c")[3:] == [20.0] * len(cells)


def test_bounds_keep_null(spark):
    rows = raw(
        spark,
        [
            {"temperature_c": "-51", "vibration_mm_s": "-1", "rpm": "10001", "energy_consumption_kwh": "-1"},
            {"temperature_c": "201", "vibration_mm_s": "101", "rpm": "-1", "energy_consumption_kwh": "1e9"},
            {"temperature_c": None, "vibration_mm_s": None, "rpm": None, "energy_consumption_kwh": None},
        ],
    )
    staged = stage(rows)
    assert column(staged, "temperature_c") == [-50.0, 200.0, None]
    assert column(staged, "vibration_mm_s") == [0.0, 100.0, None]
    assert column(staged, "rpm") == [10000.0, 0.0, None]
    assert column(staged, "energy_consumption_kwh") == [0.0, 1e9, None]


def test_infinity_takes_the_bound_or_is_missing(spark):
    rows = raw(
        spark,
        [
            {"temperature_c": "inf", "energy_consumption_kwh": "inf"},
            {"temperature_c": "-Infinity", "energy_consumption_kwh": "7"},
        ],
    )
    clean = clean_readings(rows)
    assert column(clean, "temperature_c") == [200.0, -50.0]
    assert column(clean, "energy_consumption_kwh") == [7.0, 7.0]


def test_times_apart_from_iso_text(spark):
    cells = {
        "05/06/2024 07:08": datetime(2024, 5, 6, 7, 8),
        "5/6/2024 7:08:09": datetime(2024, 5, 6, 7, 8, 9),
        "05/06/2024": datetime(2024, 5, 6),
        "2024/05/06 07:08:09": datetime(2024, 5, 6, 7, 8, 9),
        "06-May-2024": datetime(2024, 5, 6),
        "20240506": datetime(2024, 5, 6),
        "13/13/2024": None,
    }
    staged = stage(raw(spark, [{"timestamp": cell, "date": None} for cell in cells]))
    assert column(staged, "timestamp") == list(cells.values())


def test_times(spark):
    rows = raw(
        spark,
        [
            {"timestamp": "2024-12-30 23:15:00", "date": "2024-12-30"},
            {"timestamp": "bad", "date": "2024-05-06"},
            {"timestamp": None, "date": "bad"},
            {"timestamp": "2024-05-06 01:00:00", "date": None},
        ],
    )
    clean = clean_readings(rows)
    assert column(clean, "timestamp") == [
        datetime(2024, 12, 30, 23, 15), datetime(2024, 5, 6), None, datetime(2024, 5, 6, 1),
    ]
    assert column(clean, "date") == [date(2024, 12, 30), date(2024, 5, 6), None, None]
    assert column(clean, "hour") == [23, 0, None, 1]
    assert column(clean, "day_of_week") == [0, 0, None, 0]  # both are Mondays
    assert column(clean, "week") == [1, 19, None, 19]  # ISO week 1 of 2025
    assert column(clean, "year") == [2024, 2024, None, 2024]


def test_words(spark):
    names = ["shift", "equipment_id", "equipment_type", "plant_area", "manufacturer", "maintenance_type"]
    clean = clean_readings(raw(spark, [dict.fromkeys(names)]))
    assert clean.select(*names).first() == (
        "Unknown", "UNKNOWN", "Unknown", "Unknown", "Unknown", "None",
    )


def test_flags_match_exactly(spark):
    yes, no = ["1", "1.0", "Yes", "yes", "Y", "y", "True"], ["0", "No", "YES", "TRUE", " 1", "2", None]
    rows = raw(spark, [{"failure_flag": flag} for flag in yes + no])
    assert column(stage(rows), "failure_flag") == [1] * len(yes) + [0] * len(no)


def test_boolean_and_number_flags(spark):
    flags = typed(spark, [{"failure_flag": 1}, {"failure_flag": 0}])
    assert column(stage(flags), "failure_flag") == [1, 0]
    booleans = flags.withColumn("failure_flag", F.col("failure_flag") == 1)
    assert column(stage(booleans), "failure_flag") == [1, 0]


def test_failure_type_and_downtime(spark):
    rows = raw(
        spark,
        [
            {"failure_flag": "1", "failure_type": "Bearing", "downtime_minutes": "20"},
            {"failure_flag": "1", "failure_type": None, "downtime_minutes": None},
            {"failure_flag": "1", "failure_type": "Bearing", "downtime_minutes": "-5"},
            {"failure_flag": "0", "failure_type": "Bearing", "downtime_minutes": "99999"},
            {"failure_flag": "0", "failure_type": None, "downtime_minutes": "x"},
        ],
    )
    staged = stage(rows)
    assert column(staged, "failure_type") == ["Bearing", "No Failure", "Bearing", "No Failure", "No Failure"]
    assert column(staged, "downtime_minutes") == [20.0, 30.0, 30.0, 10080.0, 0.0]


def test_risk_levels_match_exactly(spark):
    words = ["low", "MEDIUM", "Med", "HIGH", "critical", "med", " High", "severe", None]
    rows = raw(spark, [{"failure_risk_level": word} for word in words])
    assert column(stage(rows), "failure_risk_level") == [
        "Low", "Medium", "Medium", "High", "Critical", "Low", "Low", "Low", "Low",
    ]


def test_first_of_repeated_ids(spark):
    rows = raw(
        spark,
        [
            {"record_id": "7", "timestamp": "2024-02-02", "shift": "b"},
            {"record_id": "7", "timestamp": "2024-02-01", "shift": "z"},
            {"record_id": None, "shift": "x"},
            {"record_id": None, "shift": "w"},
        ],
    )
    kept = drop_repeated_ids(rows)
    assert column(kept, "shift", "shift") == ["w", "z"]
    assert column(drop_repeated_ids(rows, ["shift"]), "shift", "shift") == ["b", "w"]
    assert dedup_report(rows).first() == (4, 2)


def _filled(values: list, types: list) -> list:
    """Every gap gets the median of its type, or that of all values then known."""
    known = {kind: [v for v, k in zip(values, types) if k == kind and v is not None] for kind in types}
    step = [v if v is not None or not known[k] else median(known[k]) for v, k in zip(values, types)]
    rest = median(v for v in step if v is not None)
    return [rest if v is None else v for v in step]


@pytest.mark.parametrize("few", [True, False], ids=["counts", "narrowing"])
def test_gaps_get_medians(spark, monkeypatch, few):
    either = cleaning.gap_values
    monkeypatch.setattr(cleaning, "gap_values", lambda staged: either(staged, few))
    temperatures = [10.5, None, 30.25, 11.0, None, 12.0, None, None, 99.0, 98.0, 12.0, None]
    types = ["everything"] * 3 + ["M", "M", "M", "T", "T", "*", "*", "M", "*"]
    loads = [1.0, 2.0, None, 4.0, 5.0, 6.0, None, 8.0, 9.0, 10.0, 11.0, 12.5]
    rows = typed(
        spark,
        [
            {"temperature_c": t, "equipment_type": k, "load_percent": p, "rpm": None}
            for t, k, p in zip(temperatures, types, loads)
        ],
    )
    clean = clean_readings(rows)
    assert column(clean, "temperature_c") == _filled(temperatures, types)
    assert column(clean, "load_percent") == _filled(loads, [None] * len(loads))
    assert column(clean, "rpm") == [None] * len(types)


def test_no_scan_of_whole_columns_when_every_type_has_values(spark):
    staged = stage(typed(spark, [{"temperature_c": 1.0}, {"temperature_c": None}]))
    assert gap_values(staged).first()["fill_temperature_c"] == 1.0


def test_empty_table(spark):
    clean = clean_readings(raw(spark, []))
    assert clean.count() == 0
    assert dedup_report(raw(spark, [])).first() == (0, 0)


def test_nothing_missing_and_in_range_after_cleaning(spark, sf_dir):
    import __spark_entry__ as entry

    entry.prepare_features(spark, sf_dir)
    clean = entry.queries()["clean_readings"](spark, sf_dir)
    nulls = null_profile(clean, cleaning.FILL_BY_TYPE + cleaning.FILL_BY_COLUMN).first()
    assert sum(nulls) == 0
    for name, (lower, upper) in cleaning.VALID_RANGE.items():
        outside = F.col(name) < lower if upper is None else ~F.col(name).between(lower, upper)
        assert clean.where(outside).count() == 0
