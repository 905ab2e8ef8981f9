"""Run registered queries in Spark and their SQL in DuckDB, and compare rows.

    python tests/compare.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, query, sql: str) -> tuple[bool, str, int]:
    df = query(spark, folder)
    got = _rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if got != want:
        surplus = sorted(set(got) - set(want))[:2]
        lacking = sorted(set(want) - set(got))[:2]
        return False, f"{len(got)} vs {len(want)} rows\n  spark {surplus}\n  sql   {lacking}", len(got)
    return True, "", len(got)


def main() -> int:
    import __spark_entry__ as entry

    from stmtlens.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = local_session("compare", 8), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for key in args.keys or queries:
        start = time.time()
        try:
            if key not in oracles:
                print(f"----  {key}: {queries[key](spark, folder).count()} rows, no SQL")
                continue
            ok, why, n = compare(spark, con, folder, queries[key], oracles[key])
        except Exception as error:
            ok, why, n = False, f"{type(error).__name__}: {str(error)[:1500]}", -1
            if args.keys:
                traceback.print_exc()
        print(f"{'ok  ' if ok else 'FAIL'}  {key}: {n} rows, {time.time() - start:.1f} s {why}", flush=True)
        if not ok:
            failed.append(key)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
