"""Exact medians of groups of any size.

Spark's `median` keeps every distinct value of a group in one task's memory. Two exact ways avoid
that, both shuffling counts instead of rows:

* few distinct values per group (a sensor with a fixed resolution): count each value, and find the
  middle ranks in the counts;
* many: one pass brackets the middle ranks of all groups by a quantile sketch of stated error, and a second
  counts the rows below the bracket and each value inside it. Whether the bracket holds the middle ranks is known
  exactly then. Where it does not, because rows count unlike often, three passes narrow the ranks down with counts per
  coarse bucket, then per fine bucket inside the coarse ones that hold a middle rank, then per distinct value inside the
  fine ones that do. No task holds more than the buckets of one group.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import join_written, lookup
from .shared_table import write_shared

COARSE_PER_UNIT = 1024
FINE = 65_536
ACCURACY = 4_000  # ranks of the sketch are off by 1 / ACCURACY of a group's rows at most

_GROUP = ["series", "member"]


def _coarse() -> Column:
    """Bucket on a log scale: never falls as the value rises, bounded for any finite value."""
    value = F.col("value")
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * COARSE_PER_UNIT)


def _fine() -> Column:
    low, high = F.col("low"), F.col("high")
    place = (F.col("value") - low) / F.nullif(high - low, F.lit(0.0))
    return F.floor(F.coalesce(place, F.lit(0.0)) * FINE)


def _holding_middle(counts: DataFrame, within: list[str], order: str) -> DataFrame:
    """Of counted buckets, those that hold one of the ranks `first_middle` and `second_middle`."""
    running = Window.partitionBy(*within).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    upto = F.col("before") + F.sum("n").over(running)
    return (
        counts.withColumn("upto", upto)
        .withColumn("before", F.col("upto") - F.col("n"))
        .where("before <= second_middle AND upto > first_middle")
        .drop("upto", "n")
    )


def _with_ranks(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*_GROUP))
    return (
        counts.withColumn("total", total)
        .withColumn("first_middle", F.expr("(total - 1) DIV 2"))
        .withColumn("second_middle", F.expr("total DIV 2"))
        .withColumn("before", F.lit(0).cast("bigint"))
        .drop("total")
    )


def value_counts(values: DataFrame) -> DataFrame:
    return values.where(F.col("value").isNotNull()).groupBy(*_GROUP, "value").agg(F.sum("n").alias("n"))


def group_medians(values: DataFrame, few: bool) -> DataFrame:
    """(series, member, value, n) -> (series, member, median); n is how often the row counts.

    `few` says that the caller knows of no group with many distinct values. Otherwise `values` also
    has an `id` that varies among equal values, and is scanned twice, or more often where rows count unlike often:
    it should be a cheap scan (a written table). NULL values do not count; a group without values
    has no row.
    """
    middle = _middle_of_counts(values) if few else _middle_by_bracket(values)
    median = (F.min("value") + F.max("value")) / 2
    return middle.groupBy(*_GROUP).agg(median.alias("median"))


def _middle_of_counts(values: DataFrame) -> DataFrame:
    return _holding_middle(_with_ranks(value_counts(values)), _GROUP, "value")


def _middle_by_bracket(values: DataFrame) -> DataFrame:
    values = values.where(F.col("value").isNotNull())
    ends = F.percentile_approx("value", [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY], ACCURACY)
    ranks = values.groupBy(*_GROUP).agg(F.sum("n").alias("total"), ends.alias("ends"))
    ranks = write_shared(
        ranks.select(
            *_GROUP,
            F.expr("(total - 1) DIV 2").alias("first_middle"),
            F.expr("total DIV 2").alias("second_middle"),
            F.col("ends")[0].alias("low"),
            F.col("ends")[1].alias("high"),
        )
    )
    value = F.col("value")
    side = F.when(value < F.col("low"), -1).when(value > F.col("high"), 1).otherwise(0)
    near = join_written(values, ranks, _GROUP, spread=["id"]).withColumn("side", side)
    near = near.withColumn("value", F.when(F.col("side") == 0, value))
    carried = [F.first(name).alias(name) for name in ("first_middle", "second_middle")]
    counts = write_shared(near.groupBy(*_GROUP, "side", "value").agg(F.sum("n").alias("n"), *carried))

    group = Window.partitionBy(*_GROUP)
    below, inside = (F.sum(F.when(F.col("side") == at, F.col("n")).otherwise(0)).over(group) for at in (-1, 0))
    counts = counts.withColumn("before", below).withColumn("inside", inside)
    held = F.expr("before <= first_middle AND second_middle < before + inside")
    middle = _holding_middle(counts.where(held).where("side = 0"), _GROUP, "value").select(*_GROUP, "value")
    missed = write_shared(counts.where(~held).select(*_GROUP).distinct())
    if missed.isEmpty():
        return middle
    rest = join_written(values, missed, _GROUP, spread=["id"])
    return middle.unionByName(_middle_by_narrowing(rest).select(*_GROUP, "value"))


def _middle_by_narrowing(values: DataFrame) -> DataFrame:
    values = values.where(F.col("value").isNotNull()).withColumn("coarse", _coarse())

    coarse = values.groupBy(*_GROUP, "coarse").agg(
        F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    middle = _holding_middle(_with_ranks(coarse), _GROUP, "coarse")
    near = lookup(values, middle, [*_GROUP, "coarse"], spread=["id"]).withColumn("fine", _fine())

    path = [*_GROUP, "coarse", "fine"]
    ranks = ["before", "first_middle", "second_middle"]
    carried = [F.first(name).alias(name) for name in ranks]
    fine = near.groupBy(*path).agg(F.sum("n").alias("n"), *carried)
    middle = _holding_middle(fine, path[:3], "fine")
    near = lookup(near.drop(*ranks), middle, path, spread=["id"])

    distinct = near.groupBy(*path, "value").agg(F.sum("n").alias("n"), *carried)
    return _holding_middle(distinct, path, "value")
