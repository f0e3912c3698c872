"""Joins by shuffle: heavy keys are split by measured rows, and no other row of the table is copied."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millwright.operators import lookup


def _frames(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 2000))
    facts = spark.range(60_000).select("id", key.alias("key"))
    table = spark.range(2500).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("value"))
    return facts, table.union(spark.createDataFrame([("hot", -1)], "key string, value bigint"))


def test_only_heavy_keys_are_split(spark):
    facts, table = _frames(spark)
    salted, copied = lookup.salted_sides(facts, table, ["key"], ["id"])
    assert copied.where("key <> 'hot'").groupBy("key").count().where("count > 1").isEmpty()
    parts = copied.where("key = 'hot'").count()
    assert parts == -(-lookup.HEAVY_KEYS // 3)
    sizes = [row["count"] for row in salted.groupBy("key", "_salt").count().collect()]
    assert max(sizes) <= 2 * 60_000 / lookup.HEAVY_KEYS


@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_are_those_of_a_plain_join(spark, how):
    facts, table = _frames(spark)
    found = lookup.join_written(facts, table, ["key"], ["id"], how, max_rows=0)
    assert Counter(found.collect()) == Counter(facts.join(table, "key", how).select(*found.columns).collect())
    assert lookup.join_written(facts.limit(0), table, ["key"], ["id"], how, max_rows=0).count() == 0
