"""Ids on their way through pandas, which would make floats of them where one is NULL."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "no_id"


def without_null(column: str, name: str = "doc_id") -> list[Column]:
    """The id as a bigint that is never NULL, and whether it was."""
    number = F.col(column).cast("bigint")
    return [F.coalesce(number, F.lit(0).cast("bigint")).alias(name), number.isNull().alias(NONE)]


def with_null(name: str = "doc_id") -> Column:
    """The id again."""
    return F.when(~F.col(NONE), F.col(name)).alias(name)


def column_of(ids: list[int | None]) -> pd.api.extensions.ExtensionArray:
    """Ids for a pandas frame, all digits kept."""
    return pd.array(ids, dtype="Int64")
