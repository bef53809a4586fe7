"""Runs registered queries next to their SQL and compares whole results."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal_type(name: str) -> str:
    name = name.lower()
    same = {"varchar": "string", "integer": "int", "bool": "boolean"}
    return same.get(name, name)


def sorted_rows(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(repr(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the results are the same, else what differs."""
    con.execute(f"CREATE OR REPLACE TEMP TABLE expected AS {sql}")
    expected_types = {
        n: normal_type(t) for n, t in con.execute(
            "SELECT column_name, data_type FROM information_schema.columns WHERE table_name='expected'"
        ).fetchall()
    }
    actual_types = {n: normal_type(t) for n, t in df.dtypes}
    if expected_types != actual_types:
        return f"schema: {sorted(actual_types.items() ^ expected_types.items())}"
    names = list(expected_types)
    actual = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    wanted = sorted_rows(names, con.execute(f"SELECT {', '.join(names)} FROM expected").fetchall())
    if len(actual[1]) != len(wanted[1]):
        return f"rows: {len(actual[1])} instead of {len(wanted[1])}"
    wrong = [(a, w) for a, w in zip(actual[1], wanted[1], strict=True) if a != w]
    return f"{len(wrong)} of {len(wanted[1])} rows: {actual[0]} {wrong[:3]}" if wrong else ""


def main() -> None:
    import __spark_entry__ as entry
    from volgrid.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "compare",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    chosen = sys.argv[1:] or list(entry.queries())
    for name in chosen:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            if name in sql:
                found = difference(df, con, sql[name]) or "same"
            else:
                found = f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001 - reported per query
            found = f"error: {str(error)[:1500]}"
        print(f"{name}: {found} ({time.time() - start:.1f} s)", flush=True)
    missing = set(sql) - set(entry.queries())
    print(f"{len(entry.queries())} queries, {len(sql)} with SQL, SQL without query: {missing}")


if __name__ == "__main__":
    main()
