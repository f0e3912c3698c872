"""Cleaning of raw readings: one row per record, parsed, bounded, and without gaps.

Two steps. `stage` needs one row at a time apart from dropping repeated ids: it is written once to
the shared folder. `fill_gaps` takes medians over that table and joins them to it.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..operators.dedup import first_per_key
from ..operators.lookup import join_written
from ..operators.medians import group_medians, value_counts
from ..operators.shared_table import write_shared
from ..schema import (
    FAILED_WORDS, FILE_ORDER, FILL_BY_COLUMN, FILL_BY_TYPE, FILL_WORD, FILL_ZERO, MIN_FAILURE_DOWNTIME, NO_FAILURE,
    RISK_WORDS, VALID_RANGE,
)

# Whose median it is: of one equipment type (prefix and name), or of all readings.
OF_TYPE, EVERYTHING = "type ", "everything"

# How files write times apart from ISO text; where day and month could be exchanged, the month is first.
TIME_FORMATS = [
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d",
    "d-MMM-yyyy H:mm:ss", "d-MMM-yyyy", "yyyyMMdd",
]


def clean_readings(raw: DataFrame, first_by: list[str] | None = None) -> DataFrame:
    """Raw readings to clean ones. `first_by` orders the rows of a repeated record id."""
    return fill_gaps(write_shared(stage(raw, first_by)))


# --- row rules ------------------------------------------------------------------------------


def drop_repeated_ids(raw: DataFrame, first_by: list[str] | None = None) -> DataFrame:
    """Keep the first row of each record id: by `first_by`, or by place in the files if it is known.

    A table has no first row, so otherwise the order is by time, then by all other columns: the same
    row is kept however the input is split.
    """
    if first_by is None and FILE_ORDER in raw.columns:
        first_by = [FILE_ORDER]
    others = [name for name in raw.columns if name not in ("record_id", "timestamp")]
    return first_per_key(raw, "record_id", first_by or ["timestamp", *others]).drop(FILE_ORDER)


def stage(raw: DataFrame, first_by: list[str] | None = None) -> DataFrame:
    """Every cleaning rule that needs no other row. Sensor gaps stay NULL."""
    rows = drop_repeated_ids(raw, first_by)
    kinds = dict(rows.dtypes)
    parsed_date = _time("date", kinds["date"])
    # Parse, then bound, in two steps: each cell is parsed once.
    rows = rows.withColumns(
        {
            "timestamp": F.coalesce(_time("timestamp", kinds["timestamp"]), parsed_date),
            "date": parsed_date.cast("date"),
            "failure_flag": _flag(kinds["failure_flag"]),
            **{name: _number(F.col(name), kinds[name]) for name in VALID_RANGE},
        }
    )
    rows = rows.withColumns(
        {**_time_parts(), **{name: _bounded(F.col(name), *VALID_RANGE[name]) for name in VALID_RANGE}}
    )
    rows = rows.withColumns({name: F.coalesce(name, F.lit(word)) for name, word in FILL_WORD.items()})
    rows = rows.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in FILL_ZERO})
    failed = F.col("failure_flag") == 1
    known_type = F.coalesce("failure_type", F.lit(NO_FAILURE))
    return rows.withColumns(
        {
            "failure_type": F.when(failed, known_type).otherwise(NO_FAILURE),
            "downtime_minutes": F.when(
                failed & (F.col("downtime_minutes") == 0), MIN_FAILURE_DOWNTIME
            ).otherwise(F.col("downtime_minutes")),
            "failure_risk_level": _risk_level(),
        }
    )


def _time(name: str, kind: str) -> Column:
    """Parse a time: ISO text first, then TIME_FORMATS in turn; what fits none becomes NULL."""
    cell = F.col(name)
    iso = cell.try_cast("timestamp_ntz")
    if kind != "string":
        return iso
    text = F.trim(cell)
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz") for form in TIME_FORMATS])


def _number(cell: Column, kind: str) -> Column:
    """Parse a measurement; what is no number becomes NULL.

    Java also reads '1d', '1f' and hexadecimal as numbers; those cells are text here.
    """
    value = F.nanvl(cell.try_cast("double"), F.lit(None))
    if kind != "string":
        return value
    return F.when(~cell.rlike(r"[xX]|[0-9.][dDfF]\s*$"), value)


def _bounded(value: Column, lower: float, upper: float | None) -> Column:
    """Bound a measurement; infinity is missing where there is no bound."""
    return clip(value if upper is not None else F.nullif(value, F.lit(float("inf"))), lower, upper)


def _flag(kind: str) -> Column:
    cell = F.col("failure_flag")
    text = (cell.cast("int") if kind == "boolean" else cell).cast("string")
    return F.when(text.isin(FAILED_WORDS), 1).otherwise(0)


def _time_parts() -> dict[str, Column]:
    time = F.col("timestamp")
    return {
        "hour": F.hour(time),
        "day_of_week": F.weekday(time),  # Monday = 0
        "month": F.month(time),
        "year": F.year(time),
        "week": F.weekofyear(time),  # ISO week
    }


def _risk_level() -> Column:
    level = F.lit("Low")
    for label, words in RISK_WORDS.items():
        level = F.when(F.col("failure_risk_level").isin(words), label).otherwise(level)
    return level


# --- gaps -----------------------------------------------------------------------------------


def fill_gaps(staged: DataFrame) -> DataFrame:
    """Fill missing measurements with medians, joined by equipment type."""
    fills = write_shared(gap_values(staged))
    joined = join_written(staged, fills, ["equipment_type"], spread=["record_id"])
    filled = {name: F.coalesce(name, f"fill_{name}") for name in FILL_BY_TYPE + FILL_BY_COLUMN}
    return joined.withColumns(filled).select(*staged.columns)


def gap_values(staged: DataFrame, few_values: bool = False) -> DataFrame:
    """One row per equipment type with the value that fills a gap in each measurement.

    Medians are found by narrowing down, which holds for any values. `few_values` is for a caller who
    knows that the measurements are coarse: then distinct values are counted in one pass instead.
    No data decides between the two, and both give the same values.

    A type without a single value of a sensor takes the median of the whole column, taken after the
    other types' gaps are filled.
    """
    types = write_shared(_profile(staged))
    measured = _measurements(staged)
    if few_values:
        measured = write_shared(value_counts(measured))
    medians = write_shared(group_medians(measured, few_values))
    of_type = (
        medians.where(F.col("member") != EVERYTHING)
        .groupBy(F.expr(f"substring(member, {len(OF_TYPE) + 1})").alias("equipment_type"))
        .agg(*[_median_of(name) for name in FILL_BY_TYPE])
    )
    fills = write_shared(types.join(of_type, "equipment_type", "left"))
    of_column = medians.where(F.col("member") == EVERYTHING)
    unknown = reduce(or_, [F.col(f"fill_{name}").isNull() for name in FILL_BY_TYPE])
    if not fills.where(unknown).isEmpty():
        filled_up = _with_gaps_filled(measured, fills)
        of_column = of_column.unionByName(write_shared(group_medians(filled_up, few_values)))

    constants = of_column.agg(
        F.struct(*[_median_of(name) for name in FILL_BY_TYPE + FILL_BY_COLUMN])
    ).scalar()
    return fills.withColumn("column", constants).select(
        "equipment_type",
        *[F.coalesce(f"fill_{name}", f"column.fill_{name}").alias(f"fill_{name}") for name in FILL_BY_TYPE],
        *[F.col(f"column.fill_{name}") for name in FILL_BY_COLUMN],
    )


def _profile(staged: DataFrame) -> DataFrame:
    """Per equipment type: gaps of each sensor."""
    gaps = [F.count_if(F.col(name).isNull()).alias(f"gaps_{name}") for name in FILL_BY_TYPE]
    return staged.groupBy("equipment_type").agg(*gaps)


def _median_of(name: str) -> Column:
    return F.max(F.when(F.col("series") == name, F.col("median"))).alias(f"fill_{name}")


def _cells(df: DataFrame, id_column: str, cells: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """(id, series, member, value, n) rows, one per cell and row of `df`."""
    names = ["series", "member", "value", "n"]
    rows = [
        F.struct(*[part.alias(name) for name, part in zip(names, (F.lit(series), *parts))])
        for series, *parts in cells
    ]
    return df.select(F.col(id_column).cast("string").alias("id"), F.inline(F.array(*rows)))


def _measurements(staged: DataFrame) -> DataFrame:
    """All measurements to take a median of: by type, or over everything."""
    one = F.lit(1).cast("bigint")
    member = F.concat(F.lit(OF_TYPE), "equipment_type")
    of_type = [(name, member, F.col(name), one) for name in FILL_BY_TYPE]
    of_all = [(name, F.lit(EVERYTHING), F.col(name), one) for name in FILL_BY_COLUMN]
    return _cells(staged, "record_id", of_type + of_all)


def _with_gaps_filled(measured: DataFrame, fills: DataFrame) -> DataFrame:
    """Sensors over everything, every gap of a type counting as that type's median."""
    everything = F.lit(EVERYTHING)
    of_sensors = measured.where(F.col("series").isin(FILL_BY_TYPE)).withColumn("member", everything)
    filled = _cells(
        fills,
        "equipment_type",
        [(name, everything, F.col(f"fill_{name}"), F.col(f"gaps_{name}")) for name in FILL_BY_TYPE],
    )
    return of_sensors.unionByName(filled.where("n > 0"), allowMissingColumns=True)
