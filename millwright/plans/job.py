"""The whole job: raw readings to clean readings with features, and the printed report."""

from pyspark.sql import DataFrame

from ..operators.shared_table import stored_tables, write_shared
from ..sources.readings import read_by_month, write_by_month, write_table
from .cleaning import clean_readings
from .features import add_features
from .reports import REPORT


def prepare(raw: DataFrame, path: str | None = None, first_by: list[str] | None = None) -> DataFrame:
    """Clean raw readings, add the features, and store the result at `path` by month, or in the shared folder.

    Every report reads a few columns of it, and filters on features reach the scan; a period of time reads
    the files of its months only. `first_by` orders the rows of a repeated id. Tables stored on the way are removed.
    """
    with stored_tables() as scope:
        featured = add_features(clean_readings(raw, first_by))
        if path is None:
            return scope.keep(write_shared(featured))
        write_by_month(featured, path)
        return read_by_month(featured.sparkSession, path, featured.schema)


def report(featured: DataFrame) -> dict[str, DataFrame]:
    """The report's tables by name. Each runs when it is used; those that join a summary of the
    readings write that summary here."""
    return {name: table(featured) for name, table in REPORT.items()}


def write_report(featured: DataFrame, folder: str) -> None:
    """Write every table of the report; what is stored on the way is removed."""
    with stored_tables():
        for name, table in report(featured).items():
            write_table(table, f"{folder.rstrip('/')}/{name}")
