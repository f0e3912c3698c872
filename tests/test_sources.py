import random
from datetime import datetime

import pytest

from millwright.plans.cleaning import stage
from millwright.schema import READINGS_SCHEMA, TABLE_NAME
from millwright.sources import readings

from .frames import DEFAULT, typed


def test_csv_cells_are_text_and_missing_words_are_null(spark, folder):
    path = f"{folder}/cells.csv"
    with open(path, "w") as file:
        file.write('timestamp,record_id,shift,rpm,maintenance_type\n')
        file.write('2024-01-01,1,"Day, late",NA,None\n')
        file.write('2024-01-02,2,N/A,1500,"He said ""no"""\n')
        file.write('2024-01-03,3,,nan, NA\n')
    df = readings.read_csv(spark, path).orderBy("record_id")
    assert {kind for _, kind in df.dtypes} == {"string"}
    assert df.collect() == [
        ("2024-01-01", "1", "Day, late", None, None),
        ("2024-01-02", "2", None, "1500", 'He said "no"'),
        ("2024-01-03", "3", None, None, " NA"),
    ]


def test_first_row_in_the_files_is_kept_however_they_are_split(spark, folder):
    rng, lines = random.Random(11), 400
    names = list(DEFAULT)
    first = {}
    for part in ("a", "b"):
        with open(f"{folder}/{part}.csv", "w") as file:
            file.write(",".join(names) + "\n")
            for line in range(lines):
                row = DEFAULT | {"record_id": rng.randrange(150), "shift": f"{part}{line}"}
                first.setdefault(str(row["record_id"]), row["shift"])
                file.write(",".join("" if row[name] is None else str(row[name]) for name in names) + "\n")
    for split in ("128m", "7k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        raw = readings.read_csv(spark, folder, keep_order=True)
        kept = stage(raw)
        assert "file_order" not in kept.columns
        assert dict(kept.select("record_id", "shift").collect()) == first
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_existing_sql_runs_on_the_registered_table(spark):
    readings.register(typed(spark, [{}, {"failure_flag": 1}]))
    row = spark.sql(f"SELECT count(*) n, sum(failure_flag) f FROM {TABLE_NAME}").first()
    assert (row["n"], row["f"]) == (2, 1)


def test_written_table_reads_back(spark, folder):
    df = typed(spark, [{"timestamp": datetime(2024, 1, 2, 3, 4, 5, 678901)}, dict.fromkeys(DEFAULT)])
    readings.write_table(df, f"{folder}/t")
    stored = readings.read_table(spark, f"{folder}/t")
    assert stored.schema == READINGS_SCHEMA
    assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect()))


def test_preview_and_shape(spark):
    df = typed(spark, [{"record_id": i} for i in (9, 3, 5, 1, 7, 2)])
    assert [row["record_id"] for row in readings.preview(df).collect()] == [1, 2, 3, 5, 7]
    assert readings.shape(df).first() == (6, 22)


def test_a_cluster_must_name_the_shared_folder():
    from millwright.operators import shared_table

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        shared_table.shared_folder(Cluster)
