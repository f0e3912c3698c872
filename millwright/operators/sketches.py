"""How many different machines: exactly from rows, or about from stored sketches, which merge.

`COUNT(DISTINCT)` shuffles every machine of every group. A HyperLogLog sketch of a group has a fixed size, whatever the number of
machines, and sketches of days merge into those of any period.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
SKETCH = "machines"


class Machines:
    """Exact numbers, of rows."""

    def distinct(self) -> Column:
        return F.count_distinct("equipment_id")

    def records(self) -> Column:
        return F.count(F.lit(1))


class SketchedMachines(Machines):
    """Of sketches: records are exact, machines are off by `standard_error` as a rule."""

    def distinct(self) -> Column:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(SKETCH)), F.lit(0).cast("bigint"))

    def records(self) -> Column:
        return F.coalesce(F.sum("rows"), F.lit(0).cast("bigint"))


EXACT, SKETCHED = Machines(), SketchedMachines()


def standard_error(lg_k: int = LG_K) -> float:
    """Of the number of machines of merged sketches, as a share of it: 0.8 % for 2**14 slots."""
    return 1.04 / 2 ** (lg_k / 2)


def machine_sketches(readings: DataFrame, keys: list[str | Column], lg_k: int = LG_K) -> DataFrame:
    """One row for each group: keys, number of rows, and a sketch of the machines in them."""
    sketch = F.hll_sketch_agg("equipment_id", lg_k).alias(SKETCH)
    return readings.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), sketch)
