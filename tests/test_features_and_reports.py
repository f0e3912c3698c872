from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millwright.functions.columns import band
from millwright.plans import maintenance, reports
from millwright.plans.cleaning import clean_readings
from millwright.plans.features import add_features
from millwright.plans.job import prepare, write_report
from millwright.schema import CONDITION_BANDS, URGENCY_BANDS

from .frames import column, featured, raw, typed

START = datetime(2024, 1, 1)


def _features(spark, rows):
    return add_features(clean_readings(typed(spark, rows)))


def test_bands_are_open_below(spark):
    values = [0, 0.1, 25, 25.1, 40, 50, 60, 75, 80, 100, 101, None]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double")
    df = df.select("i", band(F.col("v"), URGENCY_BANDS).alias("u"), band(F.col("v"), CONDITION_BANDS).alias("c"))
    assert column(df, "u", "i") == [
        None, "Low", "Low", "Medium", "Medium", "Medium", "High", "High", "Critical", "Critical", None, None,
    ]
    assert column(df, "c", "i") == [
        None, "Critical", "Critical", "Critical", "Critical", "Poor", "Poor", "Fair", "Fair", "Good", None, None,
    ]


def test_one_reading_per_type_has_zero_score(spark):
    df = _features(spark, [{"equipment_type": "P", "temperature_c": 10.0}, {"equipment_type": "Q", "temperature_c": 90.0}])
    assert column(df, "temp_zscore") == [0.0, 0.0]
    assert column(df, "temp_anomaly") == [0, 0]


def test_equal_values_give_no_scale_and_no_health(spark):
    df = _features(spark, [{}, {"failure_risk_level": "Critical"}])
    row = df.orderBy("record_id").collect()
    assert [r["temp_normalized"] for r in row] == [None, None]
    assert [r["health_index"] for r in row] == [None, None]
    assert [r["failure_probability"] for r in row] == [None, None]
    assert [r["maintenance_urgency"] for r in row] == [None, None]
    assert [r["high_risk_flag"] for r in row] == [0, 1]


def test_formulas(spark):
    df = _features(
        spark,
        [
            {"temperature_c": 0.0, "vibration_mm_s": 0.0, "efficiency_percent": 100.0, "load_percent": 0.0,
             "days_since_last_maintenance": 0.0, "failure_risk_level": "Low", "downtime_minutes": 90.0},
            {"temperature_c": 100.0, "vibration_mm_s": 10.0, "efficiency_percent": 0.0, "load_percent": 100.0,
             "days_since_last_maintenance": 50.0, "failure_risk_level": "Critical"},
            {"temperature_c": 50.0, "vibration_mm_s": 5.0, "efficiency_percent": 50.0, "load_percent": 50.0,
             "days_since_last_maintenance": 25.0, "failure_risk_level": "High"},
        ],
    )
    assert column(df, "health_index") == pytest.approx([100, 0, 50])
    assert column(df, "failure_probability") == pytest.approx([3, 98.5, 56])
    assert column(df, "operating_condition") == ["Good", None, "Poor"]
    assert column(df, "maintenance_urgency") == ["Low", "Critical", "High"]
    assert column(df, "high_risk_flag") == [0, 1, 1]
    assert column(df, "downtime_hours") == [1.5, 0.0, 0.0]
    assert column(df, "temp_zscore") == pytest.approx([-1, 1, 0])


def test_scores_stay_in_range(spark, sf_dir):
    import __spark_entry__ as entry

    df = entry.prepare_features(spark, sf_dir)
    outside = ~F.col("health_index").between(0, 100) | ~F.col("failure_probability").between(0, 100)
    assert df.where(outside).count() == 0


def test_mean_gap_equals_the_gaps_one_by_one(spark):
    hours = {"E1": [0, 5, 7, 30], "E2": [100], "E3": [3, 3, 9]}
    rows = [
        {"equipment_id": e, "timestamp": START + timedelta(hours=h), "failure_flag": 1, "downtime_hours": 2.0}
        for e, times in hours.items()
        for h in reversed(times)
    ]
    rows += [{"equipment_id": "E1", "timestamp": None, "failure_flag": 1}, {"equipment_id": "E2"}]
    df = featured(spark, rows)
    gaps = [5, 2, 23, 0, 6]
    assert reports.overall_kpis(df).first()["mtbf_hours"] == pytest.approx(sum(gaps) / len(gaps))
    assert reports.equipment_type_kpis(df).first()["mtbf_hours"] == pytest.approx(sum(gaps) / len(gaps))


def test_overall_without_failures_or_rows(spark):
    row = reports.overall_kpis(featured(spark, [{"operating_hours": 0.0}])).first()
    assert (row["mtbf_hours"], row["mttr_hours"], row["availability_pct"]) == (0.0, 0.0, 100.0)
    row = reports.overall_kpis(featured(spark, [])).first()
    assert (row["failure_rate_pct"], row["total_equipment"], row["availability_pct"]) == (0.0, 0, 100.0)


def test_availability_without_hours(spark):
    df = featured(
        spark,
        [
            {"equipment_id": "A", "operating_hours": 0.0, "downtime_hours": 1.0, "failure_flag": 1},
            {"equipment_id": "B", "operating_hours": 0.0},
            {"equipment_id": "C", "operating_hours": 1.0, "downtime_hours": 5.0},
            {"equipment_id": "D", "operating_hours": 10.0, "downtime_hours": 1.0, "failure_flag": 1},
        ],
    )
    table = reports.downtime_per_equipment(df)
    assert column(table, "availability_pct", "equipment_id") == [0.0, None, 0.0, 90.0]
    assert column(table, "avg_downtime_per_failure", "equipment_id") == [1.0, 0.0, None, 1.0]


def test_health_ties_share_a_rank(spark):
    health = {"A": 50.0, "B": 20.0, "C": 50.0, "D": 90.0, "E": None, "F": 50.0}
    df = featured(spark, [{"equipment_id": e, "health_index": h} for e, h in health.items()])
    table = reports.equipment_health(df)
    assert column(table, "maintenance_priority", "equipment_id") == [3.0, 1.0, 3.0, 5.0, None, 3.0]
    assert [row["equipment_id"] for row in table.collect()] == ["B", "A", "C", "F", "D", "E"]


def test_alerts(spark):
    df = featured(
        spark,
        [
            {"equipment_id": "A", "high_risk_flag": 1, "failure_risk_level": "High", "health_index": 45.0},
            {"equipment_id": "A", "high_risk_flag": 1, "failure_risk_level": "Low", "health_index": 60.0},
            {"equipment_id": "B", "high_risk_flag": 1, "failure_risk_level": "Critical", "health_index": 29.0},
            {"equipment_id": "C", "high_risk_flag": 1, "failure_risk_level": "Medium"},
            {"equipment_id": "D"},
        ],
    )
    rows = reports.predictive_alerts(df).collect()
    assert [(r["equipment_id"], r["alert_severity"], r["risk_level"]) for r in rows] == [
        ("B", "CRITICAL", "Critical"), ("A", "HIGH", "High"), ("C", "MEDIUM", "Medium"),
    ]
    assert reports.predictive_alerts(featured(spark, [{}])).count() == 0


def test_failure_analysis_without_failures(spark):
    assert reports.failure_analysis(featured(spark, [{}])).count() == 0


def test_months_without_a_time_do_not_count(spark):
    df = featured(spark, [{}, {"year": None, "month": None, "timestamp": None}])
    assert [(r["year"], r["month"], r["total_records"]) for r in reports.monthly_trends(df).collect()] == [(2024, 5, 1)]


def test_latest_months_are_the_last_twelve_in_order(spark):
    df = featured(spark, [{"year": 2023 + i // 12, "month": i % 12 + 1} for i in range(15)])
    months = [(r["year"], r["month"]) for r in reports.latest_months(df).collect()]
    assert months == [(2023 + i // 12, i % 12 + 1) for i in range(3, 15)]


def test_filtered_view(spark):
    df = featured(
        spark,
        [
            {"timestamp": START},
            {"timestamp": START + timedelta(days=1), "equipment_id": "E2"},
            {"timestamp": START + timedelta(days=2), "maintenance_type": "Corrective"},
            {"timestamp": START + timedelta(days=3), "operating_condition": "Good"},
        ],
    )
    assert maintenance.filtered_view(df).count() == 4
    assert column(maintenance.filtered_view(df, equipment_id="E2"), "record_id") == [2]
    assert column(maintenance.filtered_view(df, maintenance_type="Corrective"), "record_id") == [3]
    assert column(maintenance.filtered_view(df, operating_condition="Good"), "record_id") == [4]
    period = maintenance.filtered_view(df, start=START + timedelta(days=1), end=START + timedelta(days=3))
    assert column(period, "record_id") == [2, 3]


def test_report_from_a_csv_file(spark, sf_dir, folder, capsys):
    import __spark_entry__ as entry
    import run_report
    from millwright.sources.event_readings import as_raw

    raw_rows = as_raw(entry.prepare_readings(spark, sf_dir))
    raw_rows.write.option("header", True).csv(f"{folder}/input.csv")
    run_report.main(f"{folder}/input.csv", f"{folder}/out")
    assert "equipment_type_kpis" in capsys.readouterr().out
    written = spark.read.parquet(f"{folder}/out/overall_kpis").first()
    known = reports.overall_kpis(entry.prepare_features(spark, sf_dir)).first()
    assert written == pytest.approx(known)


def test_job_writes_the_report(spark, folder):
    rows = [
        {"equipment_id": f"E{i % 3}", "temperature_c": str(40 + i), "vibration_mm_s": str(i), "failure_flag": str(i % 2)}
        for i in range(9)
    ]
    write_report(prepare(raw(spark, rows), f"{folder}/features"), folder)
    for name in ["features", *reports.REPORT]:
        assert spark.read.parquet(f"{folder}/{name}").count() > 0, name
