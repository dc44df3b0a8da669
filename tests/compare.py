"""Compare a query's rows with its SQL on the same parquet tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(r) for r in df.collect()]


def _sorted(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    picked = [tuple(row[i] for i in order) for row in rows]
    return [names[i] for i in order], sorted(picked, key=lambda r: tuple(map(repr, r)))


def difference(spark_result, sql_result) -> str | None:
    """None when both hold the same rows in any order, else a short description."""
    names, rows = _sorted(*spark_result)
    sql_names, expected = _sorted(*sql_result)
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    for row, other in zip(rows, expected):
        if tuple(map(repr, row)) != tuple(map(repr, other)):
            return f"{str(row)[:600]}\n  != {str(other)[:600]}"
    return None
