"""Compare registered queries with their SQL on an independent engine.

    python -m tests.compare [folder] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from bidlake import build_session
from bidlake.plans.catalogue import REGISTRY
from bidlake.sources.tables import Tables


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in Tables.NAMES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=str)


def _plain(value: object) -> object:
    if isinstance(value, float):
        return float(f"{value:.12g}") + 0.0
    return value


def difference(spark_rows: tuple, sql_rows: tuple) -> str | None:
    (sc, sd), (dc, dd) = spark_rows, sql_rows
    if sorted(sc) != sorted(dc):
        return f"columns {sorted(sc)} vs {sorted(dc)}"
    a, b = rows(sc, sd), rows(dc, dd)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}: {a[:2]} {b[:2]}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ: {wrong[:2]}" if wrong else None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection, failures = connect(folder), 0
    for name in [n for n in REGISTRY if any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]:
        start = time.time()
        try:
            df = REGISTRY[name](spark, folder)
            got = (df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if REGISTRY[name].sql is None:
                print(f"ROWS {name} {len(got[1])} rows {took:.1f}s", flush=True)
                continue
            result = connection.execute(REGISTRY[name].sql)
            problem = difference(got, ([d[0] for d in result.description], result.fetchall()))
        except Exception as error:  # report and go on
            took, problem = time.time() - start, f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s {len(got[1]) if not problem else problem}", flush=True)
    print(f"{failures} failures")
    return int(failures > 0)


if __name__ == "__main__":
    sys.exit(main())
