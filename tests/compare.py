"""Run registered queries and their SQL side by side: ``python -m tests.compare <data dir> [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

import __spark_entry__ as contract


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def duck(data_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in sorted(Path(data_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a Spark result and the result of its SQL, or None."""
    got = rows_of(df.columns, df.collect())
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    expected = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    kinds = [str(column[1]).upper() for column in result.description]
    spark_kinds = dict(df.dtypes)
    for name, kind in zip(names, kinds):
        if _KINDS.get(spark_kinds[name]) != kind:
            return f"{name}: {spark_kinds[name]} against {kind}"
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    for mine, theirs in zip(got, expected):
        if mine != theirs:
            return f"{mine} against {theirs}"
    return None


_KINDS = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


def main(data_dir: str, names: list[str]) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(data_dir)
    statements = contract.oracle_sql()
    for name, query in contract.queries().items():
        if names and name not in names:
            continue
        if name not in statements:
            print(f"none {name} (no SQL)", flush=True)
            continue
        start = time.time()
        found = difference(query(spark, data_dir), connection, statements[name])
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
