from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millwright import catalog
from millwright.plans import dashboard, downtime, health, maintenance, quality, reliability, risk, sensors

from .frames import column, typed

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def readings(spark, sf_dir):
    return entry.prepare_readings(spark, sf_dir)


@pytest.mark.parametrize("name", catalog.ON_READINGS)
def test_no_measure_fails_without_rows(name, spark):
    catalog.ON_READINGS[name](typed(spark, [])).collect()


def test_rates(spark):
    df = typed(spark, [{"failure_flag": 1}, {}, {}, {"equipment_type": None}])
    assert reliability.failure_rate_overall(df).first() == (4, 1, Decimal("25.00"))
    assert reliability.failure_rate_by_type(df).collect() == [
        ("Pump", 3, 1, Decimal("33.33")), (None, 1, 0, Decimal("0.00")),
    ]


def test_types_add_up_to_the_whole(readings):
    total = reliability.failure_rate_overall(readings).first()
    by_type = reliability.failure_rate_by_type(readings).agg(F.sum("total_records"), F.sum("failures"))
    assert by_type.first() == (total["total_records"], total["total_failures"])


@pytest.mark.parametrize(
    "measure, key, share",
    [
        (risk.risk_distribution, None, "percentage"),
        (risk.risk_distribution_by_type, "equipment_type", "percentage_within_type"),
        (risk.risk_distribution_by_area, "plant_area", "percentage_within_area"),
    ],
)
def test_shares_add_up(readings, measure, key, share):
    totals = measure(readings).groupBy(*[key] if key else []).agg(F.sum(share).alias("total"))
    for row in totals.collect():
        assert abs(row["total"] - 100) <= Decimal("0.05")


def test_severity_order(spark):
    levels = ["Low", "Critical", "High", "Medium", None]
    df = typed(spark, [{"failure_risk_level": level} for level in levels])
    assert [r[0] for r in risk.risk_distribution(df).collect()] == ["High", "Medium", "Low", "Critical"]


def test_intervals_use_the_meter(spark):
    df = typed(
        spark,
        [
            {"failure_flag": 1, "operating_hours": 10.0, "timestamp": START},
            {"failure_flag": 0, "operating_hours": 11.0, "timestamp": START + timedelta(hours=1)},
            {"failure_flag": 1, "operating_hours": None, "timestamp": START + timedelta(days=1)},
            {"failure_flag": 1, "operating_hours": 50.0, "timestamp": START + timedelta(days=2)},
            {"failure_flag": 1, "operating_hours": 53.0, "timestamp": START + timedelta(days=2, minutes=5)},
        ],
    )
    row = reliability.mtbf_by_equipment(df).first()
    # Gaps: unknown (the meter was not read), 50 (the one before was not read), 3.
    assert row["failure_intervals"] == 3
    assert (row["mtbf_hours"], row["min_time_between_failures"], row["max_time_between_failures"]) == (26.5, 3, 50)


def test_unknown_machine_counts_from_zero(spark):
    df = typed(
        spark,
        [
            {"equipment_id": None, "failure_flag": 1, "operating_hours": h, "timestamp": START + timedelta(days=h)}
            for h in (10.0, 25.0)
        ],
    )
    assert reliability.mtbf_by_equipment(df).first()["mtbf_hours"] == 25.0


def test_hours_per_failure_without_failures(spark):
    assert reliability.mtbf_by_type(typed(spark, [{}])).first()["mtbf_hours"] is None


def test_ratios_beyond_five_digits(spark):
    df = typed(
        spark,
        [
            {"equipment_id": "A", "failure_flag": 1, "downtime_minutes": 1.0},
            *[{"equipment_id": f"B{i}", "failure_flag": 1, "downtime_minutes": 0.0} for i in range(99)],
        ],
    )
    top = downtime.downtime_vs_benchmark(df).first()
    assert (top["equipment_id"], top["variance_from_benchmark_pct"], top["performance_category"]) == (
        "A", Decimal("9900.00"), "Critical",
    )


def test_benchmark_of_zero(spark):
    df = typed(spark, [{"failure_flag": 1, "downtime_minutes": 0.0}])
    row = downtime.downtime_vs_benchmark(df).first()
    assert (row["variance_from_benchmark_pct"], row["performance_category"]) == (None, "Average")


def test_downtime_counts_failures_with_known_downtime(spark):
    df = typed(
        spark,
        [
            {"failure_flag": 1, "downtime_minutes": 30.0, "failure_type": "X"},
            {"failure_flag": 1, "downtime_minutes": 90.0},
            {"failure_flag": 1, "downtime_minutes": None, "failure_type": "X"},
            {"failure_flag": 0, "downtime_minutes": 1000.0},
        ],
    )
    total = downtime.downtime_overall(df).first()
    assert (total["total_downtime_minutes"], total["total_failure_events"]) == (120.0, 2)
    by_type = downtime.downtime_by_failure_type(df).collect()
    assert [(r["failure_type"], r["percentage_of_total_downtime"]) for r in by_type] == [("X", Decimal("25.00"))]


def test_top_machines_have_a_total_order(spark):
    df = typed(spark, [{"equipment_id": f"E{i:02d}", "failure_flag": 1, "downtime_minutes": 5.0} for i in range(15)])
    assert [r["equipment_id"] for r in downtime.downtime_top10(df).collect()] == [f"E{i:02d}" for i in range(10)]


def test_worst_average_needs_three_failures(spark):
    df = typed(
        spark,
        [{"equipment_id": e, "failure_flag": 1, "downtime_minutes": 5.0} for e in "AAABB"],
    )
    assert [r["equipment_id"] for r in downtime.downtime_worst_average(df).collect()] == ["A"]


def test_health_scores_and_status(spark):
    machines = {
        "A": {"temperature_c": 50.0, "vibration_mm_s": 2.0, "efficiency_percent": 100.0, "failure_risk_level": "Low"},
        "B": {"temperature_c": 100.0, "vibration_mm_s": 20.0, "efficiency_percent": 0.0, "failure_risk_level": "High"},
        "C": {"temperature_c": 75.0, "vibration_mm_s": 12.0, "efficiency_percent": None, "failure_risk_level": None},
        "D": {"temperature_c": None},
    }
    df = typed(spark, [{"equipment_id": e, **values} for e, values in machines.items()])
    rows = health.health_index_by_equipment(df).collect()
    assert [(r["equipment_id"], r["health_index"], r["health_status"]) for r in rows] == [
        ("A", Decimal("100.00"), "Excellent"), ("C", Decimal("62.35"), "Good"), ("B", Decimal("0.00"), "Critical"),
    ]
    assert (rows[1]["avg_eff_score"], rows[1]["avg_risk_score"]) == (20.0, 25.0)


def test_wild_raw_values_do_not_overflow(spark):
    df = typed(spark, [{"efficiency_percent": -1e7, "failure_flag": 1, "downtime_minutes": 1e9, "failure_type": "X"},
                       {"efficiency_percent": 1e7, "failure_flag": 1, "downtime_minutes": 1.0 - 1e9}])
    for measure in catalog.ON_READINGS.values():
        measure(df).collect()


def test_latest_reading_and_scaled_rate(spark):
    df = typed(
        spark,
        [
            {"equipment_id": "A", "timestamp": START, "failure_flag": 1, "failure_risk_level": "High"},
            {"equipment_id": "A", "timestamp": START + timedelta(days=1), "failure_risk_level": "Medium"},
            {"equipment_id": "B", "timestamp": START, "record_id": 9, "failure_risk_level": "High"},
            {"equipment_id": "B", "timestamp": START, "record_id": 8, "failure_risk_level": "Low"},
        ],
    )
    rows = risk.failure_probability_current(df).collect()
    assert [(r["equipment_id"], r["adjusted_failure_probability_pct"]) for r in rows] == [
        ("B", Decimal("75.000")), ("A", Decimal("37.500")),
    ]


def test_probability_categories(spark):
    rows = []
    for machine, failures in {"A": 10, "B": 5, "C": 2, "D": 1}.items():
        rows += [{"equipment_id": machine, "failure_flag": int(i < failures)} for i in range(100)]
    table = risk.failure_probability_historical(typed(spark, rows)).collect()
    assert [(r["equipment_id"], r["predicted_risk_category"]) for r in table] == [
        ("A", "Very High"), ("B", "High"), ("C", "Medium"), ("D", "Low"),
    ]


def test_outliers_need_a_deviation(spark):
    df = typed(spark, [{"temperature_c": 5.0, "vibration_mm_s": 5.0}] * 3)
    assert quality.temp_outliers(df).count() == 0
    assert quality.vibration_outliers(df).count() == 0
    assert sensors.vib_alerts(df).count() == 0


def test_quality_checks(spark):
    df = typed(
        spark,
        [
            {"record_id": 1, "rpm": None},
            {"record_id": 1, "rpm": -1.0, "timestamp": None},
            {"record_id": 2, "failure_flag": 1, "failure_type": "X", "downtime_minutes": 3.0, "timestamp": None},
            {"record_id": 3, "failure_flag": 1, "failure_type": None, "downtime_minutes": 3.0},
            {"record_id": 4, "downtime_minutes": 3.0, "operating_hours": -1.0},
            {"record_id": 5, "efficiency_percent": 101.0, "load_percent": 101.0},
        ],
    )
    assert quality.completeness(df).first()["records_with_timestamp"] == 4
    assert column(quality.null_sensors(df), "record_id") == [1]
    assert quality.duplicate_record_ids(df).collect() == [(1, 2)]
    assert sorted(r["duplicate_count"] for r in quality.duplicate_readings(df).collect()) == [2, 4]
    assert column(quality.out_of_range_sensors(df), "record_id") == [1, 5]
    assert column(quality.illogical_hours(df), "record_id") == [4, 5]
    assert column(quality.failure_consistency(df), "record_id") == [3, 4]


def test_dashboard_counts_known_machines(spark):
    df = typed(
        spark,
        [
            {"equipment_id": None, "failure_risk_level": "High", "failure_flag": 1, "downtime_minutes": None},
            {"equipment_id": "A", "failure_risk_level": "High"},
            {"equipment_id": "A", "failure_risk_level": "Low", "failure_flag": 1, "downtime_minutes": 120.0},
            {"equipment_id": "B"},
        ],
    )
    row = dashboard.dashboard_executive(df).first()
    assert (row["total_equipment"], row["high_risk_equipment"], row["total_failures"]) == (2, 1, 2)
    assert (row["mttr_hours"], row["total_downtime_hours"]) == (Decimal("2.00"), Decimal("2.00"))
    assert (row["failure_rate_pct"], row["high_risk_pct"]) == (Decimal("50.00"), Decimal("50.00"))
    assert dashboard.dashboard_by_type(df).first()["high_risk_count"] == 1


def test_remaining_life(spark):
    times = [("A", 0, 1), ("A", 10, 1), ("A", 30, 1), ("A", 34, 0), ("B", 0, 1), ("B", 5, 0)]
    df = typed(
        spark,
        [{"equipment_id": e, "timestamp": START + timedelta(hours=h), "failure_flag": f} for e, h, f in times],
    )
    assert maintenance.remaining_useful_life(df).collect() == [("A", 3, 15.0, 4.0, 11.0)]
