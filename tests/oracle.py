"""Comparison of a query with its oracle; also a command: python -m tests.oracle [sf] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

from parlance.catalog import oracle_sql, queries
from parlance.catalog.inputs import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, (Decimal, float)):
        number = float(value)
        return "nan" if math.isnan(number) else repr(number + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, name: str, folder: str) -> str | None:
    """None when equal, else what differs. A query without oracle must only return rows."""
    df = queries()[name](spark, folder)
    got, got_columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want, want_columns = rows_of(want_columns, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first extra {next(iter(set(got) ^ set(want)), None)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    path = f"/root/testdata/sf{sf}"
    con = connect(path)
    chosen = [n for n in queries() if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            problem = compare(session, con, name, path)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {(problem or '')[:700]}", flush=True)
    print(f"{len(chosen) - failed}/{len(chosen)} ok")
