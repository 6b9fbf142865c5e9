"""Compare queries with their SQL in DuckDB.

As a script: ``python tests/oracle.py [sf] [name prefix ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

SLOW = float(os.environ.get("SLOW", "5"))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime) and value.tzinfo is not None:
        return value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return value


def kind(value) -> str:
    return type(value).__name__


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((value is not None, kind(value), value) if value is not None
                              else (False, "", 0) for value in row),
    )


def difference(df, sql: str, connection) -> str | None:
    """None if both results are equal, else what differs."""
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    expected = rows_of(names, cursor.fetchall())
    actual = rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns: {sorted(df.columns)} instead of {sorted(names)}"
    if len(actual) != len(expected):
        return f"rows: {len(actual)} instead of {len(expected)}; {actual[:2]} / {expected[:2]}"
    for got, wanted in zip(actual, expected):
        if got != wanted or [kind(v) for v in got] != [kind(v) for v in wanted]:
            return f"row {got} instead of {wanted}"
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as target
    from usageledger.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    sql = target.oracle_sql()
    bad = 0
    for name, run in target.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            problem = difference(run(spark, sf_dir), sql[name], connection)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        if problem or time.time() - started > SLOW:
            print(f"{'BAD' if problem else 'slow':5}{name} {time.time() - started:.1f}s {problem or ''}", flush=True)
        bad += bool(problem)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
