"""Value-by-value comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duckdb_connection(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def plain(value):
    """One spelling per value: numbers exact, timestamps as ISO text."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, decimal.Decimal):
        raise TypeError("decimals must be shown as doubles")
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        raise TypeError("dates must be shown as text")
    return value


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain_rows = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(plain_rows, key=lambda row: [(v is not None, type(v).__name__, v) for v in row])


def differences(df, connection, sql: str, limit: int = 3) -> list[str]:
    """Empty when both sides have the same columns and exactly the same rows."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    expected = canonical(names, result.fetchall())
    actual = canonical(df.columns, df.collect())
    found = [f"{len(actual)} rows != {len(expected)} rows"] if len(actual) != len(expected) else []
    for mine, theirs in zip(actual, expected):
        if mine != theirs or [type(v) for v in mine] != [type(v) for v in theirs]:
            found.append(f"{mine} != {theirs}")
            if len(found) >= limit:
                break
    return found
