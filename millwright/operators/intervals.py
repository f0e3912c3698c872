"""Difference to the previous row of the same key, without one task per key."""

from pyspark.sql import DataFrame

from . import segments


def previous_pairs(
    df: DataFrame, key: str, time: str, tie: str, payload: list[str]
) -> DataFrame:
    """Pair each row with the previous one of its key by (time, tie), NULL first.

    Returns key, `current` and `previous` (structs of payload); a key's first row has no pair.

    Rows are dealt by range of (key, time, tie) into segments of like size, so neither a hot key nor many rows
    at one time, or without a time, load one task. Pairs are formed inside each segment; the pair of a segment's first
    row comes from one row for each segment.
    """
    rows = df.select(key, time, tie, *[name for name in payload if name not in (key, time, tie)])
    return segments.previous(segments.cut(rows, [key], [time, tie]), [key], [time, tie], payload)
