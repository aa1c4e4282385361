"""Run registered queries and compare them with their SQL check in DuckDB.

usage: python tools/check_queries.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None if value is None else "nan"
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def rows_of(columns, rows):
    names = sorted(columns)
    index = [list(columns).index(n) for n in names]
    return names, sorted((tuple(_plain(r[i]) for i in index) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str:
    """Empty when equal, else a short description of the difference."""
    got_names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}" if bad else ""


def main() -> int:
    from surveyloom.plans import oracle_sql, queries
    from surveyloom.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("check", 8)
    con = connect(folder)
    checks = oracle_sql()
    failed = 0
    for name, run in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in checks:
                problem = compare(run(spark, folder), con, checks[name])
            else:
                problem = "" if run(spark, folder).collect() else "no rows"
        except Exception as error:
            traceback.print_exc(limit=3)
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        mark = "FAIL" if problem else "ok  " if name in checks else "rows"
        print(f"{mark} {name:34s} {time.time() - start:6.1f}s {problem}", flush=True)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
