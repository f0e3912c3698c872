"""Segments of hot keys, and tables that go when their scope ends."""

import random
from pathlib import Path
from statistics import median
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from millwright.operators import segments, shared_table
from millwright.operators.intervals import previous_pairs
from millwright.operators.shared_table import drop_shared, shared_folder, stored_tables, write_shared


def _count():
    return {"n": (F.lit(1).cast("bigint"), segments.SUM)}


def _rows(spark, count=2000):
    rng = random.Random(4)
    rows = [
        (rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, 1, 1, 1, 2]), rng.randrange(5), rng.randrange(-9, 99))
        for _ in range(count)
    ]
    return rows, spark.createDataFrame(rows, "k string, t int, id int, v long").repartition(7)


@pytest.mark.parametrize("count", [1, 13, 200])
def test_running_totals_equal_plain_ones(spark, count):
    rows, df = _rows(spark)
    cut = segments.cut(df, ["k"], ["t", "id"], count)
    totals = _count() | {"s": (F.col("v"), segments.SUM), "x": (F.col("v"), segments.XOR)}
    found = segments.running(cut, ["k"], ["t", "id"], totals).collect()
    assert len(found) == len(rows)
    for key in ("hot", "a", "b", None):
        total, both = 0, 0
        mine = sorted((r for r in found if r.k == key), key=lambda r: (r.t is not None, r.t or 0, r.id, r._row))
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
        for row in mine:
            total, both = total + row.v, both ^ row.v
            assert (row.s, row.x) == (total, both)


def test_no_rows_and_one_row(spark):
    _, df = _rows(spark, 1)
    assert segments.running(segments.cut(df, ["k"], ["t"], 5), ["k"], ["t"], _count()).first().n == 1
    none = segments.cut(df.limit(0), ["k"], ["t"], 5)
    assert segments.running(none, ["k"], ["t"], _count()).count() == 0
    assert segments.previous(none, ["k"], ["t"], ["v"]).count() == 0
    assert segments.plain(none).columns == df.columns


def test_one_machine_at_one_time_is_split_evenly(spark):
    """A third of all rows on one machine, all at one time; the tie is an id, or nothing at all."""
    machine = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 500))
    time = F.when(F.col("id") % 3 != 0, F.col("id"))
    df = spark.range(90_000).select(machine.alias("k"), time.alias("t"), "id", F.lit(7).alias("same"))
    for order in (["t", "id"], ["t", "same"]):
        sizes = [r["count"] for r in segments.cut(df, ["k"], order, 24).groupBy("k", "slot").count().collect()]
        parts = [r["count"] for r in segments.cut(df, ["k"], order, 24).groupBy("slot").count().collect()]
        assert sum(parts) == 90_000 and max(parts) <= 2 * median(parts) and max(sizes) <= 2 * 90_000 / 24


def test_pairs_need_no_order_of_input(spark):
    df = spark.createDataFrame([("a", 3, 1), ("a", 1, 2), ("b", 5, 3), ("a", None, 4), (None, 1, 5), (None, 2, 6)], "k string, t int, id int")
    found = {(r.k, r.current.id, r.previous.id) for r in previous_pairs(df, "k", "t", "id", ["id"]).collect()}
    assert found == {("a", 2, 4), ("a", 1, 2), (None, 6, 5)}


def _folders(spark) -> set[str]:
    root = Path(urlparse(shared_folder(spark)).path)
    return {path.name for path in root.iterdir() if path.name.startswith("millwright-")} if root.exists() else set()


def test_tables_go_with_their_scope(spark):
    before = _folders(spark)
    with stored_tables():
        kept = write_shared(spark.range(5))
        with stored_tables() as inner:
            gone = write_shared(spark.range(6))
            handed_on = inner.keep(write_shared(spark.range(7)))
            assert gone.count() == 6 and len(_folders(spark) - before) == 3
        assert kept.count() == 5 and handed_on.count() == 7 and len(_folders(spark) - before) == 2
        drop_shared(kept)
        assert len(_folders(spark) - before) == 1
    assert _folders(spark) == before


def test_tables_go_after_an_error(spark):
    before = _folders(spark)
    with pytest.raises(ZeroDivisionError), stored_tables():
        write_shared(spark.range(5))
        1 / 0  # noqa: B018
    assert _folders(spark) == before


def test_tables_without_a_scope_stay_until_they_are_dropped(spark):
    before = _folders(spark)
    table = write_shared(spark.range(5).withColumn("part", F.col("id") % 2))
    with stored_tables() as scope:
        assert scope.keep(table).where("part = 1").count() == 2
    assert table.count() == 5
    drop_shared(table.where("id > 2"))
    assert _folders(spark) == before


@pytest.mark.parametrize("mounted", ["false", "true"])
def test_a_cluster_needs_a_folder_that_all_share(mounted):
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: mounted if name == shared_table.MOUNTED else "file:///data/shared")

        class sparkContext:
            master = "spark://host:7077"

    if mounted == "true":
        assert shared_folder(Cluster) == "file:///data/shared"
    else:
        with pytest.raises(ValueError):
            shared_folder(Cluster)
