"""Run named queries against their SQL twins and report differences.

    python -m tests.oracle_check [folder] [name ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = pathlib.Path(folder) / f"{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, connection, sql: str) -> str | None:
    """None when both results have the same columns and the same rows."""
    cursor = connection.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    expected = rows_of(expected_columns, cursor.fetchall())
    if sorted(expected_columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(expected_columns)}"
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return f"{a} != {b}"
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types of {a} != {b}"
    return None


def main() -> int:
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
    import __spark_entry__ as contract
    from ledger_spark.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8, extra={"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, twins = contract.queries(), contract.oracle_sql()
    failures = 0
    for name, query in queries.items():
        if chosen and name not in chosen:
            continue
        started = time.perf_counter()
        try:
            found = difference(query(spark, folder), connection, twins[name])
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.perf_counter() - started:.2f}s", found or "")
    print("missing twins:", sorted(set(queries) - set(twins)), "extra:", sorted(set(twins) - set(queries)))
    return failures


if __name__ == "__main__":
    sys.exit(main())
