"""Run registered queries and their SQL twins side by side.

``python -m checks.compare SF_DIR [QUERY ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import oracle, queries
from checks.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return value


def _sorted(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """Empty if equal, otherwise what differs."""
    df = queries.QUERIES[name](spark, sf_dir)
    ours = _sorted([tuple(row) for row in df.collect()], df.columns)
    cursor = con.execute(oracle.oracle(name))
    columns = [d[0] for d in cursor.description]
    theirs = _sorted(cursor.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        ours_first, theirs_first = different[0]
        cells = [(a, b) for a, b in zip(ours_first, theirs_first) if a != b]
        return f"{len(different)} rows differ, first in {str(cells)[:500]}"
    return ""


def main() -> None:
    sf_dir, *names = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or queries.QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{name:28s} {time.time() - start:6.1f}s {problem or 'equal'}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
