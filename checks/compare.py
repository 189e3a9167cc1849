"""Runs registered queries and their SQL side by side.

``python -m checks.compare [sf_dir] [query ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows in a fixed order, columns by name."""
    columns = sorted(frame.columns)
    plain = [tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)]
    return sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


def difference(actual: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} instead of {sorted(expected.columns)}"
    left, right = rows(actual), rows(expected)
    if len(left) != len(right):
        return f"{len(left)} rows instead of {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main(arguments: list[str]) -> int:
    from checks.oracle import oracle_sql
    from checks.queries import QUERIES

    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = connect(sf_dir), oracle_sql()
    failed = 0
    for name in names:
        try:
            start = time.time()
            actual = QUERIES[name](spark, sf_dir).toPandas()
            middle = time.time()
            expected = connection.execute(sql[name]).df()
            problem = difference(actual, expected)
            note = f"{len(actual)} rows, spark {middle - start:.2f} s, sql {time.time() - middle:.2f} s"
        except Exception as error:  # report and go on with the next query
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name}: {problem or note}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
