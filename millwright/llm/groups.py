"""Give every row the aggregates of its group, also where one group holds a large part of all rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_GROUPS = 1000
PLAIN_ROWS = 1000


def with_group(rows: DataFrame, keys: list[str], total: int, *aggregates: Column, names: str | None = None) -> DataFrame:
    """`rows` with aggregates of their group; `total` is the number of rows, or more.

    A group of more than total / HOT_GROUPS rows is hot. There can be at most HOT_GROUPS of these, so
    their aggregates are broadcast and the rows of a hot group stay where they are. All other groups
    are joined by shuffle. Both aggregate map-side first and share one exchange.

    `names` adds a column with one integer for each distinct key: cold keys are sorted within their
    partition and numbered from 1, hot ones are numbered downwards from -1.

    Rows with a NULL key are left out. `rows` is read three times, so it should be a stored table or a projection of one.
    """
    for key in keys:  # said here once, it is the same plan, and so one exchange, for all uses below
        rows = rows.where(F.col(key).isNotNull())
    most = max(PLAIN_ROWS, total // HOT_GROUPS)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *aggregates)

    def cold_of(groups: DataFrame) -> DataFrame:
        if names:
            groups = groups.sortWithinPartitions(*keys).withColumn(names, F.monotonically_increasing_id() + 1)
        return groups.drop("_rows")

    if total <= PLAIN_ROWS:  # no group can be hot
        return rows.join(cold_of(counted), keys)
    cold = cold_of(counted.where(F.col("_rows") <= most))
    hot = counted.where(F.col("_rows") > most).drop("_rows")
    if names:
        first = hot.agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("all"))  # HOT_GROUPS keys at most
        number = first.select(F.posexplode("all").alias("at", "key"))
        number = number.select((-1 - F.col("at")).cast("bigint").alias(names), "key.*")
        hot = hot.join(F.broadcast(number), keys)
    hot_keys = F.broadcast(hot.select(*keys))
    in_hot = rows.join(F.broadcast(hot), keys)
    in_cold = rows.join(hot_keys, keys, "left_anti").join(cold, keys)
    return in_cold.unionByName(in_hot)
