"""CSV files as they are, and SQL functions of filtered readings."""

from collections import Counter
from datetime import datetime

import pandas as pd
import pytest

import __spark_entry__ as entry
from millwright import catalog
from millwright.plans import cleaning
from millwright.plans.maintenance import filtered_view
from millwright.sources import readings


def _bag(df) -> Counter:
    return Counter(map(str, df.collect()))


@pytest.fixture
def files(folder):
    texts = {
        "a": 'record_id,equipment_id,failure_type\n1,EQ-1,"two\nlines, ""quoted"""\n2,EQ-2,NA\n',
        "b": 'failure_type,record_id,shift\n"worn\r\n part",3,Night\n,4,"Day"\n',
        "c": '"record_id","equipment_id","failure_type"\n5,EQ-5,plain\n',
    }
    for name, text in texts.items():
        with open(f"{folder}/{name}.csv", "w", newline="") as file:
            file.write(text)
    return folder


def test_files_with_own_headers_and_line_breaks_equal_pandas(spark, files):
    found = readings.read_csv(spark, files, by_name=True, multi_line=True)
    expected = pd.concat([pd.read_csv(f"{files}/{name}.csv", dtype=str) for name in "abc"])
    assert set(found.columns) == set(expected.columns)
    rows = expected[found.columns].astype(object).where(expected[found.columns].notna(), None)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows.itertuples(index=False, name=None), key=str)


def test_order_is_kept_beside_own_headers(spark, folder):
    for name, text in {"a": "record_id,shift\n7,first\n8,x\n", "b": "shift,record_id\nlater,7\n"}.items():
        with open(f"{folder}/{name}.csv", "w") as file:
            file.write(text)
    rows = readings.read_csv(spark, folder, keep_order=True, by_name=True)
    assert sorted(r.shift for r in cleaning.drop_repeated_ids(rows).collect()) == ["first", "x"]


def test_rows_of_a_wrong_length_are_shown(spark, folder):
    with open(f"{folder}/a.csv", "w") as file:
        file.write("record_id,shift\n1,Day\n2,Day,more\n3\n4,NA\n")
    for by_name in (False, True):
        found = readings.read_csv(spark, folder, by_name=by_name, bad_records="bad")
        assert found.columns == ["record_id", "shift", "bad"]
        assert sorted(map(tuple, found.collect())) == [("1", "Day", None), ("2", "Day", "2,Day,more"), ("3", None, "3"), ("4", None, None)]


def test_sql_functions_of_filtered_readings(spark, sf_dir):
    typed = entry.prepare_readings(spark, sf_dir)
    readings.register_filtered(typed)
    start, end = datetime(2024, 2, 1), datetime(2024, 5, 1)
    period = f"since => TIMESTAMP_NTZ'{start}', before => TIMESTAMP_NTZ'{end}'"
    found = spark.sql(f"SELECT * FROM {readings.TABLE_NAME}_of({period}, maintenance => 'Preventive')")
    rows = filtered_view(typed, start=start, end=end, maintenance_type="Preventive")
    assert found.columns == typed.columns and found.count() > 0
    for name in ("failure_rate_by_type", "mtbf_by_type", "temp_overall"):
        assert _bag(catalog.ON_READINGS[name](found)) == _bag(catalog.ON_READINGS[name](rows))
    assert spark.sql(f"SELECT * FROM {readings.TABLE_NAME}_of()").count() == typed.count()
    plan = spark._jvm.PythonSQLUtils.explainString(found.select("shift")._jdf.queryExecution(), "formatted")
    assert "EqualTo(maintenance_type,Preventive)" in plan and "LessThan(timestamp," in plan


def test_sql_functions_of_features_filter_by_condition(spark, sf_dir):
    featured = entry.prepare_features(spark, sf_dir)
    readings.register_filtered(featured, "features_of", "features")
    found = spark.sql("SELECT count(*) FROM features_of(condition => 'Fair', machine => 'EQ-00001')").first()[0]
    assert found == featured.where("operating_condition = 'Fair' AND equipment_id = 'EQ-00001'").count()
