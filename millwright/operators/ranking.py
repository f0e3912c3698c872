"""Rank over all rows of a table, without sorting them in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lookup import lookup

BUCKETS = 10_000
DECIMALS = 9


def average_rank(
    df: DataFrame, value: str, lower: float, upper: float, into: str, spread: list[str]
) -> DataFrame:
    """Add the ascending rank of `value`, equal values sharing the mean of their ranks.

    Values lie in lower..upper. They are counted per distinct value first, so ties never meet in one
    group; each of BUCKETS equal ranges is ranked by itself; and the ranges' running total, at most
    BUCKETS + 1 rows, shifts the ranks. Values are compared at DECIMALS decimals, so that the order
    in which a mean was summed does not split ties. NULL has no rank.
    """
    keyed = df.withColumn("_value", F.round(value, DECIMALS))
    values = keyed.where(F.col("_value").isNotNull()).groupBy("_value").agg(F.count(F.lit(1)).alias("n"))
    place = (F.col("_value") - lower) / (upper - lower) * BUCKETS
    values = values.withColumn("bucket", F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(BUCKETS)))

    inside = Window.partitionBy("bucket").orderBy("_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # All of at most BUCKETS + 1 rows.
    below = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = values.groupBy("bucket").agg(F.sum("n").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("shift")
    )
    last = F.col("shift") + F.sum("n").over(inside)
    ranks = values.join(F.broadcast(shifts), "bucket").select(
        "_value", (last - (F.col("n") - 1) / 2).alias(into)
    )
    return lookup(keyed, ranks, ["_value"], spread, how="left").drop("_value")
