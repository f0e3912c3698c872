"""Join of a large table with a summary of itself, broadcast only after its size is known."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_table import write_shared

BROADCAST_ROWS = 100_000
BROADCAST_TEXT_BYTES = 16 << 20
HEAVY_KEYS = 256  # a key with a larger share of all rows than one in so many is heavy


def fits_broadcast(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Measure a written table: number of rows and bytes of text."""
    texts = [name for name, kind in table.dtypes if kind == "string"]
    size = F.octet_length(F.concat_ws("", *texts)) if texts else F.lit(0)
    rows, text = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and text <= BROADCAST_TEXT_BYTES


def join_written(
    facts: DataFrame, table: DataFrame, on: list[str], spread: list[str], how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join `facts` with a written `table` that has one row per key.

    A table of checked size is broadcast, so `facts` is not shuffled. A larger one is joined by
    shuffle: the rows of each key are counted, and a heavy key is split by a hash of `spread`, columns that vary
    within a key, into parts of like size, so that a key holding a third of all rows spreads over many tasks. The table's
    row is copied for each part of a heavy key; all other rows of the table are there once.
    """
    if fits_broadcast(table, max_rows):
        return facts.join(F.broadcast(table), on, how)
    salted, copied = salted_sides(facts, table, on, spread)
    return salted.join(copied.hint("merge"), [*on, "_salt"], how).drop("_salt")


def salted_sides(facts: DataFrame, table: DataFrame, on: list[str], spread: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with a column `_salt` to join by, too: 0, but for the parts of heavy keys."""
    key = F.xxhash64(*on)  # keys that share a hash share their parts
    counts = write_shared(facts.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = counts.where(F.col("n") > total / HEAVY_KEYS).collect()  # HEAVY_KEYS rows at most
    parts = F.lit(1)
    if heavy:  # other keys are passed over by one look-up in a set
        parts = F.when(~key.isin([row.key for row in heavy]), 1)
        for row in heavy:
            parts = parts.when(key == row.key, math.ceil(row.n * HEAVY_KEYS / total))
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), parts.cast("bigint")))
    last = parts.cast("bigint") - 1
    return salted, table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))


def lookup(
    facts: DataFrame, summary: DataFrame, on: list[str], spread: list[str], how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Write `summary` once, measure it, and join it to `facts`."""
    return join_written(facts, write_shared(summary), on, spread, how, max_rows)
