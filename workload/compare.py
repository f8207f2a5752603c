"""Runs queries on Spark and their SQL on DuckDB and compares the rows.

    python -m workload.compare [folder] [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

from tablelore.session import build_session

from .registry import QUERIES
from .tables import COLUMNS, Tables


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "__float__"):
        return _plain(float(value)) if not isinstance(value, int) else value
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, connection, folder: str, name: str) -> str | None:
    """What is wrong with one query; None where both engines agree or there is no SQL."""
    query = QUERIES[name]
    frame = query.run(Tables(spark, folder))
    rows = frame.collect()
    if query.sql is None:
        return None if rows else "no rows"
    result = connection.execute(query.sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    ours, theirs = rows_of(frame.columns, rows), rows_of(names, expected)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}; only ours {list(set(ours) - set(theirs))[:2]}, only theirs {list(set(theirs) - set(ours))[:2]}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} rows differ, e.g. {wrong[0]}" if wrong else ("no rows" if not rows else None)


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in COLUMNS:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def main(arguments: list[str]) -> int:
    folder = arguments[0] if arguments else "/root/testdata/sf0.001"
    names = arguments[1:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            problem = differences(spark, connection, folder, name)
        except Exception as failure:  # show it and go on
            problem = f"{type(failure).__name__}: {str(failure)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s"
              f"{' (no SQL)' if QUERIES[name].sql is None else ''} {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
