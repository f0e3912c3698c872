"""Reading, registering, previewing and writing the readings table."""

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import FILE_ORDER, NA_TOKENS, READINGS_SCHEMA, TABLE_NAME


def read_csv(
    spark: SparkSession, path: str, keep_order: bool = False, by_name: bool = False, multi_line: bool = False,
    bad_records: str | None = None,
) -> DataFrame:
    """Raw readings from CSV with a header row: every cell as text, missing-value words as NULL.

    Cells stay text because a bad cell must become NULL by itself (see the cleaning plan), and
    because inferring types would cost one more pass over the files. `keep_order` adds each row's
    place (file, start of its split, row in the split), so that cleaning keeps the first row of a
    repeated id as the files list them, however they are split over tasks.

    The header is that of any file, and all must be equal. With `by_name` each file has its own: columns are united by name, and one that
    a file lacks is NULL there. This reads the files' lines once more, and one scan for each different header. `multi_line`
    reads quoted line breaks; a file is then one task. `bad_records` names a column for the text of rows with more or fewer
    cells than the header; it is NULL for all others.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    if by_name:
        headers = _headers(spark, path)
        parts = [_cells(spark, files, options, names, bad_records, keep_order) for names, files in headers.items()]
        return reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), parts)
    names = spark.read.options(**options).csv(path).columns if bad_records else None
    return _cells(spark, [path], options, names, bad_records, keep_order)


def _cells(
    spark: SparkSession, files: list[str], options: dict, names: tuple[str, ...] | None, bad_records: str | None, keep_order: bool
) -> DataFrame:
    reader = spark.read.options(**options)
    if names:
        schema = StructType([StructField(name, StringType()) for name in [*names, *([bad_records] if bad_records else [])]])
        reader = reader.schema(schema)
        if bad_records:
            reader = reader.option("columnNameOfCorruptRecord", bad_records)
    cells = reader.csv(files)
    columns = [F.col(f"`{name}`") if name == bad_records else blank_to_null(f"`{name}`").alias(name) for name in cells.columns]
    if keep_order:
        place = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
        )
        columns.append(place.alias(FILE_ORDER))
    return cells.select(columns)


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of each different header, in the order of their names."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), "value", place.alias("place"))
    first = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))  # names of files, which the driver lists, too
    headers: dict[tuple[str, ...], list[str]] = {}
    for header, files in sorted(found.collect(), key=lambda row: row.files):
        names = tuple(next(csv.reader([header.removeprefix("\ufeff").rstrip("\r")])))
        headers.setdefault(names, []).extend(files)
    return headers


def blank_to_null(name: str) -> Column:
    cell = F.col(name)
    return F.when(~cell.isin(NA_TOKENS), cell)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Typed readings from Parquet."""
    return spark.read.schema(READINGS_SCHEMA).parquet(path)


def register(readings: DataFrame, name: str = TABLE_NAME) -> DataFrame:
    """Make the readings available to SQL under the table name existing queries use."""
    readings.createOrReplaceTempView(name)
    return readings


def register_filtered(readings: DataFrame, function: str = f"{TABLE_NAME}_of", name: str = TABLE_NAME) -> None:
    """Let SQL take any measure of some readings: `function(machine => ..., since => ..., before => ..., maintenance => ..., condition => ...)`.

    Arguments left out do not filter; there is none for a column the table lacks. Spark puts the function's query in place of
    its call, so the tests reach the scan.
    """
    register(readings, name)
    tests = {
        "machine": ("STRING", "equipment_id", "="), "since": ("TIMESTAMP_NTZ", "timestamp", ">="), "before": ("TIMESTAMP_NTZ", "timestamp", "<"),
        "maintenance": ("STRING", "maintenance_type", "="), "condition": ("STRING", "operating_condition", "="),
    }
    tests = {argument: test for argument, test in tests.items() if test[1] in readings.columns}
    arguments = ", ".join(f"{argument} {kind} DEFAULT NULL" for argument, (kind, _, _) in tests.items())
    wanted = [f"({function}.{argument} IS NULL OR {column} {sign} {function}.{argument})" for argument, (_, column, sign) in tests.items()]
    columns = ", ".join(f"`{column}`" for column in readings.columns)
    readings.sparkSession.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {function}({arguments}) RETURNS TABLE "
        f"RETURN SELECT {columns} FROM {name} WHERE {' AND '.join(wanted)}"
    )


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count")
    )


def preview(df: DataFrame, order_by: str = "record_id", rows: int = 5) -> DataFrame:
    """The first few rows in a stated order."""
    return df.orderBy(F.col(order_by).asc_nulls_last()).limit(rows)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a result as Parquet.

    With `partition_by`, rows of one folder are brought together first, so that not every task writes a file into every folder; adaptive
    execution splits a folder that holds much and joins small ones, by measured size.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


MONTH = ["year", "month"]


def write_by_month(df: DataFrame, path: str, time: str = "timestamp", files: int | None = None) -> None:
    """Write rows with columns year and month into a folder for each month, in order of `time` within.

    Rows are dealt by range of month and time into `files` parts of like size, so a month that holds most of them is spread over
    many files, each of a narrow range of time, and there are at most `files` and one more for each month. A filter on
    year and month reads the folders it names, one on `time` besides skips files and row groups.
    """
    files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col(name).asc_nulls_first() for name in [*MONTH, time, "_row"]]
    dealt = placed.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("_row")
    dealt.write.mode("overwrite").partitionBy(*MONTH).parquet(path)


def read_by_month(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that `write_by_month` wrote, its columns in the order of `schema`."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)
