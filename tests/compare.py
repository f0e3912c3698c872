"""Run a query in Spark and its SQL in DuckDB, and compare names, types and values."""

import re
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()

_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean",
}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def expected(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[dict, Counter]:
    result = con.sql(sql)
    types = {name: _spark_type(str(kind)) for name, kind in zip(result.columns, result.types)}
    return types, _bag(result.columns, result.fetchall())


def actual(df: DataFrame) -> tuple[dict, Counter]:
    return dict(df.dtypes), _bag(df.columns, [tuple(row) for row in df.collect()])


def _spark_type(kind: str) -> str:
    decimal = re.fullmatch(r"DECIMAL\((\d+),(\d+)\)", kind)
    return f"decimal({decimal[1]},{decimal[2]})" if decimal else _TYPES.get(kind, kind)


def _bag(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def _plain(value):
    return value + 0.0 if isinstance(value, float) else value  # -0.0 equals 0.0
