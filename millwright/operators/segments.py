"""Work along the order of rows within keys, when one key may hold most of the rows.

Rows are dealt by range of (key, order), so a hot key is spread over many segments of like size and every key
lies in neighbouring segments. What one segment needs of those before it is one row of each.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared_table import write_shared

SEGMENT = "slot"
_ROW = "_row"  # tells rows apart that are equal in all else, so that these are split, too

#: How values of earlier segments join those of a later one.
SUM = (F.sum, lambda before, here: before + here)
XOR = (F.bit_xor, lambda before, here: before.bitwiseXOR(here))


def cut(rows: DataFrame, keys: list[str], order: list[str], segments: int | None = None) -> DataFrame:
    """Store `rows` with their segment, dealt by range of keys, order and place; NULL first."""
    segments = segments or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn(_ROW, F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(segments, *[_up(name) for name in [*keys, *order, _ROW]])
    return write_shared(dealt.withColumn(SEGMENT, F.spark_partition_id()))


def previous(segmented: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Pair each row with the one before it of its keys: keys, `current` and `previous` (structs of payload).

    A key's first row has no pair. `segmented` is a result of `cut` by the same keys and order.
    """
    rows = segmented.withColumn("current", F.struct(*payload))
    within = Window.partitionBy(*keys, SEGMENT).orderBy(*[_up(name) for name in [*order, _ROW]])
    inside = rows.select(
        *keys, "current", F.lag("current").over(within).alias("previous"), F.row_number().over(within).alias("_at")
    )
    inside = inside.where("_at > 1").drop("_at")

    # one row for each segment: the pair of its first row, if the segment before ends in the same key
    place = F.struct(*keys, *order, _ROW)
    row = F.struct(*keys, "current")
    ends = rows.groupBy(SEGMENT).agg(F.min_by(row, place).alias("first"), F.max_by(row, place).alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy(SEGMENT))).where("before IS NOT NULL")
    for name in keys:
        ends = ends.where(F.col(f"first.{name}").eqNullSafe(F.col(f"before.{name}")))
    between = ends.select("first.*", F.col("before.current").alias("previous"))
    return inside.unionByName(between)


def running(
    segmented: DataFrame, keys: list[str], order: list[str], totals: dict[str, tuple[Column, tuple[Callable, Callable]]],
) -> DataFrame:
    """`segmented` with running totals up to and with each row: {name: (value, SUM or XOR)}; values are never NULL.

    Only keys that lie in several segments need a row of the segments before, and at most one key goes on from a
    segment to the next. So there are fewer than twice as many such rows as segments; these are broadcast.
    """
    values = {f"_v{at}": value for at, (value, _) in enumerate(totals.values())}
    ways = dict(zip(values, totals.items()))
    rows = segmented.withColumns(values)
    within = Window.partitionBy(*keys, SEGMENT).orderBy(*[_up(name) for name in [*order, _ROW]])
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({name: total(F.col(value)).over(so_far) for value, (name, (_, (total, _))) in ways.items()})

    place = F.struct(*keys, *order, _ROW)
    key = F.struct(*keys)
    ends = segmented.groupBy(SEGMENT).agg(F.min_by(key, place).alias("first"), F.max_by(key, place).alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy(SEGMENT)))
    several = ends.where(F.col("before").isNotNull() & F.col("first").eqNullSafe(F.col("before")))
    several = F.broadcast(several.select(F.col("first").alias("_spans")).distinct())
    parts = rows.withColumn("_key", key).join(several, key.eqNullSafe(F.col("_spans")), "left_semi")
    parts = parts.groupBy("_key", SEGMENT).agg(*[total(value).alias(value) for value, (_, (_, (total, _))) in ways.items()])
    earlier = Window.partitionBy("_key").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        F.col("_key").alias("_of"), F.col(SEGMENT).alias("_at"),
        *[total(value).over(earlier).alias(f"_c{value}") for value, (_, (_, (total, _))) in ways.items()],
    )
    same = F.struct(*keys).eqNullSafe(F.col("_of")) & (F.col(SEGMENT) == F.col("_at"))
    joined = local.join(F.broadcast(carried), same, "left")
    whole = {
        name: F.when(F.col(f"_c{value}").isNull(), F.col(name)).otherwise(join(F.col(f"_c{value}"), F.col(name)))
        for value, (name, (_, (_, join))) in ways.items()
    }
    return joined.withColumns(whole).drop("_of", "_at", *values, *[f"_c{value}" for value in values])


def plain(segmented: DataFrame) -> DataFrame:
    """Without the columns that `cut` added."""
    return segmented.drop(SEGMENT, _ROW)


def _up(name: str) -> Column:
    return F.col(name).asc_nulls_first()
