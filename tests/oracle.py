"""Compare registered queries with their SQL on the given tables."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

DATA = os.environ.get("TESTDATA", "/root/testdata")


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value: object) -> str:
    if value is None or value is pd.NaT:
        return "NULL"
    if isinstance(value, float):
        return "NaN" if value != value else repr(value + 0.0)
    return str(value)


def _lines(columns: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    ours = _lines(df.columns, [tuple(x) for x in df.collect()])
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    theirs = _lines(columns, found.fetchall())
    problems = []
    if sorted(df.columns) != sorted(columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} rows != {len(theirs)}")
    if not problems and ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
        problems.append(f"{len(bad)} rows differ, first: {bad[0][0]} != {bad[0][1]}")
    if not ours:
        problems.append("no rows")
    return problems


def main(names: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import local_session

    sf_dir = f"{DATA}/sf{os.environ.get('SF', '0.001')}"
    spark, con = local_session(), database(sf_dir)
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in sql:
                problems = differences(spark, con, query, sql[name], sf_dir)
            else:
                problems = [] if query(spark, sf_dir).collect() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        note = "ok" if not problems else "; ".join(problems)
        print(f"{name:32s} {time.time() - start:6.2f}s {'' if name in sql else '(rows only) '}{note}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
