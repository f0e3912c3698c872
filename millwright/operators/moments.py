"""Counts, sums, ranges and spreads of measurements: taken of rows, or of states of groups of rows, which merge.

A state of a column holds the number of its values, their sum, least, most, and M2, the sum of their squared deviations from their
mean. States of disjoint groups merge without the rows: M2 of the whole is the sum of all M2 and of the squared
deviations of the groups' means, each as often as the group has values.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_COLUMN = "rows"


class Rows:
    """Measurements of rows."""

    def measured(self, df: DataFrame, column: str) -> DataFrame:
        return df.where(F.col(column).isNotNull())

    def rows(self) -> Column:
        return F.count(F.lit(1))

    def rows_when(self, condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    def count(self, column: str) -> Column:
        return F.count(column)

    def mean(self, column: str, when: Column | None = None) -> Column:
        return F.avg(column if when is None else F.when(when, F.col(column)))

    def total(self, column: str) -> Column:
        return F.sum(column)

    def least(self, column: str) -> Column:
        return F.min(column)

    def most(self, column: str) -> Column:
        return F.max(column)

    def deviation(self, column: str) -> Column:
        return F.stddev_samp(column)


class States(Rows):
    """Measurements of merged states; conditions must be on columns that a state's rows share.

    `centers` has a number near the mean of each column, from which deviations of means are taken: the nearer, the more digits are kept.
    """

    def __init__(self, centers: dict[str, float]) -> None:
        self.centers = centers

    @classmethod
    def of(cls, states: DataFrame) -> "States":
        columns = [name.removesuffix("_m2") for name in states.columns if name.endswith("_m2")]
        means = [F.try_divide(F.sum(f"{name}_total"), F.sum(f"{name}_n")) for name in columns]
        return cls(dict(zip(columns, (mean or 0.0 for mean in states.agg(*means).first()), strict=True)))

    def measured(self, df: DataFrame, column: str) -> DataFrame:
        return df.where(F.col(f"{column}_n") > 0)

    def rows(self) -> Column:
        return F.coalesce(F.sum(ROWS_COLUMN), F.lit(0))

    def rows_when(self, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(ROWS_COLUMN)).otherwise(0))

    def count(self, column: str) -> Column:
        return F.coalesce(F.sum(f"{column}_n"), F.lit(0))

    def mean(self, column: str, when: Column | None = None) -> Column:
        total, n = F.col(f"{column}_total"), F.col(f"{column}_n")
        if when is not None:
            total, n = F.when(when, total), F.when(when, n)
        return F.try_divide(F.sum(total), F.sum(n))

    def total(self, column: str) -> Column:
        return F.sum(f"{column}_total")

    def least(self, column: str) -> Column:
        return F.min(f"{column}_least")

    def most(self, column: str) -> Column:
        return F.max(f"{column}_most")

    def deviation(self, column: str) -> Column:
        n = F.col(f"{column}_n")
        off = F.col(f"{column}_total") - n * self.centers[column]
        m2 = F.sum(f"{column}_m2") + F.sum(F.try_divide(off * off, n)) - F.try_divide(F.sum(off) * F.sum(off), F.sum(n))
        return F.sqrt(F.try_divide(F.greatest(m2, F.lit(0.0)), F.sum(n) - 1))


ROWS = Rows()


def states(rows: DataFrame, keys: list[str | Column], columns: list[str]) -> DataFrame:
    """One state for each group: keys, the number of rows, and for each column its n, total, least, most and m2."""
    parts = [F.count(F.lit(1)).alias(ROWS_COLUMN)]
    for name in columns:
        m2 = F.var_pop(name) * F.count(name)
        values = {"n": F.count(name), "total": F.sum(name), "least": F.min(name), "most": F.max(name), "m2": m2}
        parts += [value.alias(f"{name}_{part}") for part, value in values.items()]
    return rows.groupBy(*keys).agg(*parts)
