"""Features stored by month, results written without small files, and jobs that leave no table behind."""

import time
from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millwright.operators import medians
from millwright.operators.shared_table import stored_tables, write_shared
from millwright.plans import job, maintenance
from millwright.sources import readings
from millwright.sources.event_readings import as_raw

from .test_segments import _folders


@pytest.fixture(scope="module")
def featured(spark, sf_dir):
    return entry.prepare_features(spark, sf_dir)


def _plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _bag(df) -> Counter:
    return Counter(map(str, df.collect()))


def _shuffled(spark) -> set[str]:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {name for name in blocks.split() if name.startswith("shuffle_")}


def test_storing_a_table_leaves_nothing_it_shuffled(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = _shuffled(spark), spark.conf.get(setting)
    with stored_tables():
        stored = write_shared(spark.range(10_000).groupBy(F.xxhash64("id").alias("key")).count())
        until = time.time() + 10
        while _shuffled(spark) - before and time.time() < until:
            time.sleep(0.1)  # executors are told, not waited for
        assert not _shuffled(spark) - before and stored.count() == 10_000
    assert spark.conf.get(setting) == was


def test_a_period_reads_its_months_only(spark, featured, folder):
    readings.write_by_month(featured, f"{folder}/t", files=12)
    stored = readings.read_by_month(spark, f"{folder}/t", featured.schema)
    assert stored.schema == featured.schema and _bag(stored) == _bag(featured)
    files = list(Path(f"{folder}/t").rglob("*.parquet"))
    months = {path.parent for path in files}
    assert len(files) <= 12 + len(months)

    start, end = datetime(2024, 3, 10), datetime(2024, 5, 1)
    view = maintenance.filtered_view(stored, start=start, end=end, by_month=True)
    assert _bag(view) == _bag(featured.where((F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end))))
    plan = _plan(view.select("health_index"))
    assert "PartitionFilters: [" in plan and "year" in plan[plan.index("PartitionFilters: [") :].split("\n")[0]
    scanned = stored.where("year * 12 + month BETWEEN 2024 * 12 + 3 AND 2024 * 12 + 5").select(F.input_file_name()).distinct().collect()
    read = {row[0] for row in view.select(F.input_file_name()).distinct().collect()}
    assert read <= {row[0] for row in scanned} and len(read) < len(files)


def test_a_month_with_most_rows_is_split_by_time(spark, folder):
    hot = F.when(F.col("id") % 3 > 0, F.lit("2024-05-07 08:00:00")).otherwise(F.concat(F.lit("2023-0"), F.col("id") % 9 + 1, F.lit("-02 00:00:00")))
    time = F.when(F.col("id") % 100 > 0, hot).cast("timestamp_ntz")
    df = spark.range(30_000).select("id", time.alias("timestamp"))
    df = df.withColumns({"year": F.year("timestamp"), "month": F.month("timestamp")})
    readings.write_by_month(df, f"{folder}/t", files=16)
    stored = readings.read_by_month(spark, f"{folder}/t", df.schema)
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 30_000 and max(sizes) <= 2 * 30_000 / 16 and len(sizes) <= 16 + 11
    assert stored.where("timestamp IS NULL").count() == 300


def test_a_folder_of_a_partitioned_result_has_few_files(spark, folder):
    df = spark.range(0, 4000, 1, 16).withColumn("part", F.col("id") % 5)
    readings.write_table(df, f"{folder}/t", partition_by=["part"])
    assert len(list(Path(f"{folder}/t").rglob("*.parquet"))) == 5
    assert spark.read.parquet(f"{folder}/t").count() == 4000


def test_jobs_leave_no_table_behind(spark, sf_dir, folder):
    raw = as_raw(entry.prepare_readings(spark, sf_dir)).limit(300)
    before = _folders(spark)
    featured = job.prepare(raw, f"{folder}/features")
    job.write_report(featured, f"{folder}/report")
    assert _folders(spark) == before
    assert {path.name for path in Path(f"{folder}/report").iterdir()} == set(job.REPORT)
    with stored_tables():
        stored = job.prepare(raw)
        assert stored.count() == featured.count() and len(_folders(spark) - before) == 1
    assert _folders(spark) == before


def _values(spark, rows):
    df = spark.createDataFrame(rows, "series string, member string, value double, n bigint")
    return write_shared(df.withColumn("id", F.monotonically_increasing_id()))


def test_brackets_hold_the_middle_unless_rows_count_unlike_often(spark, monkeypatch):
    rows = [("s", f"g{at % 3}", float(at * 7919 % 100_003), 1) for at in range(30_000)] + [("s", "ties", 4.0, 1)] * 999
    weighted = [("s", "heavy", 1.0, 5), ("s", "heavy", 2.0, 1), ("s", "heavy", 9.0, 90), ("s", "heavy", 8.0, 1)]
    expected = medians.group_medians(_values(spark, rows + weighted), True)
    assert _bag(medians.group_medians(_values(spark, rows + weighted), False)) == _bag(expected)
    monkeypatch.setattr(medians, "_middle_by_narrowing", lambda values: 1 / 0)
    assert _bag(medians.group_medians(_values(spark, rows), False)) == _bag(expected.where("member <> 'heavy'"))
