"""Compare registered queries with their SQL in DuckDB.

    python tools/check_queries.py [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from wishgrid.queries import ORACLES, QUERIES  # noqa: E402
from wishgrid.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "0.0" if v == 0 else repr(v))
    if isinstance(v, int):
        return (3, v)
    return (4, str(v))


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - started
    if name not in ORACLES:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    started = time.time()
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - started
    info = f"{len(got)}/{len(want)} rows, {took:.1f}s/{sql_took:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"{info} columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        left = [x for x in a if x not in set(b)][:3]
        right = [x for x in b if x not in set(a)][:3]
        return False, f"{info}\n   {sorted(names)}\n   spark only {left}\n   sql only   {right}"
    if not got:
        info += " EMPTY"
    return True, info


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("check")
    con = connect(sf_dir)
    chosen = [n for n in QUERIES if not args.names or any(n.startswith(p) for p in args.names)]
    bad = 0
    for name in chosen:
        try:
            ok, info = compare(spark, con, sf_dir, name)
        except Exception as exc:  # noqa: BLE001
            ok, info = False, "".join(traceback.format_exception_only(exc))[:900]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {info}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
