"""Run registered queries next to their SQL in DuckDB and report differences.

    python tools/check_queries.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from weirworks.catalog import load  # noqa: E402
from weirworks.session import build_session  # noqa: E402


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(spark, connection, query, sql, sf_dir):
    """(ok, message, seconds) of one query."""
    started = time.time()
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(row) for row in df.collect()])
    seconds = time.time() - started
    if sql is None:
        return True, f"{len(mine[1])} rows, no SQL", seconds
    result = connection.execute(sql)
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return False, f"columns {mine[0]} != {theirs[0]}", seconds
    if len(mine[1]) != len(theirs[1]):
        return False, f"{len(mine[1])} rows != {len(theirs[1])}", seconds
    for a, b in zip(mine[1], theirs[1]):
        if a != b:
            return False, f"spark {a} != sql {b}", seconds
    return True, f"{len(mine[1])} rows", seconds


def connect(sf_dir):
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        master=f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load()
    connection = connect(args.sf)
    bad = 0
    for name in args.names or queries:
        try:
            ok, message, seconds = compare(spark, connection, queries[name], oracles.get(name), args.sf)
        except Exception as error:  # report and go on with the next query
            ok, message, seconds = False, f"{type(error).__name__}: {str(error)[:600]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {seconds:6.2f}s {message}", flush=True)
    print(f"{bad} failed")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
