"""Column expressions shared by the plans. All are built-in, codegen-friendly Spark expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def failed() -> Column:
    return F.col("failure_flag") == 1


def high_risk() -> Column:
    return F.col("failure_risk_level") == "High"


def by_month() -> list[Column]:
    return [F.year("date").alias("year"), F.month("date").alias("month")]


def failure_count() -> Column:
    return F.sum(F.when(failed(), 1).otherwise(0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL where whole is 0 (ANSI mode would fail)."""
    return part / F.nullif(whole, F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent as DECIMAL(5,2); only for shares that cannot pass 100."""
    return two_decimals(ratio(part * 100.0, whole), digits=5)


def two_decimals(value: Column, digits: int = 18) -> Column:
    """DECIMAL(digits,2); 18 digits are wide enough for sums and unbounded ratios.

    The last bits of a mean depend on the order its values were added in. Rounding them away first
    makes a half go up in every run.
    """
    return F.round(value, 9).cast(f"decimal({digits},2)")


def failure_rate() -> Column:
    return percent(failure_count(), F.count(F.lit(1)))


def clip(value: Column, lower: float | None, upper: float | None) -> Column:
    """Bound a value; NULL stays NULL (greatest/least would turn it into the bound)."""
    out = value
    if upper is not None:
        out = F.when(value > upper, F.lit(float(upper))).otherwise(out)
    if lower is not None:
        out = F.when(value < lower, F.lit(float(lower))).otherwise(out)
    return out


def band(value: Column, bands: list[tuple[float, float, str]]) -> Column:
    """Label of the band (lower, upper] the value lies in; NULL outside all bands."""
    out = F.lit(None).cast("string")
    for lower, upper, label in bands:
        out = F.when((value > lower) & (value <= upper), label).otherwise(out)
    return out


def order_of(value: Column, labels: list[str]) -> Column:
    """Position of a label in a list; labels not listed come last."""
    out = F.lit(len(labels))
    for position, label in enumerate(labels):
        out = F.when(value == label, position).otherwise(out)
    return out


def severity_order() -> Column:
    return order_of(F.col("failure_risk_level"), ["High", "Medium", "Low"])


def first_by(measure: Column, keys: list[str]) -> list[Column]:
    """Sort by a measure, ties by the keys.

    Without the keys, a value that many rows share (a rate of 0) would send them all to one task.
    """
    return [measure, *[F.col(key) for key in keys]]


def hours_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(3.6e9)
