"""One row per record id."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, order_by: list[str | Column]) -> DataFrame:
    """Keep the first row of each key; rows with a NULL key count as one group.

    `row_number() = 1` lets Spark cut each group to one row per task before the shuffle
    (WindowGroupLimit), so a key that repeats in a third of all rows does not load one task.
    """
    window = Window.partitionBy(key).orderBy(*order_by)
    return df.withColumn("_position", F.row_number().over(window)).where("_position = 1").drop("_position")
