"""Run registered queries against their SQL in DuckDB and report differences.

usage: python tools/check.py [--sf 0.01] [--time] [name prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return str(v)


def rows_of(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(entry, spark, con, sf_dir):
    df = entry.run(spark, sf_dir)
    t0 = time.time()
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - t0
    if entry.sql is None:
        return "rows", len(got), spent, ""
    cur = con.execute(entry.oracle())
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return "COLS", len(got), spent, f"{df.columns} vs {cols}"
    a, b = rows_of(got, df.columns), rows_of(want, cols)
    if a == b:
        return "ok", len(got), spent, ""
    in_a, in_b = set(a), set(b)
    diff_a = [x for x in a if x not in in_b][:2]
    diff_b = [x for x in b if x not in in_a][:2]
    return "DIFF", len(got), spent, f"spark {len(a)} sql {len(b)} {sorted(df.columns)} n_diff {len(in_a - in_b)}/{len(in_b - in_a)} spark-only {diff_a} sql-only {diff_b}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--block-rows", default=None)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from barline.catalog.all import load
    from barline.session import local_session

    spark = local_session()
    if args.block_rows:
        spark.conf.set("spark.barline.blockRows", args.block_rows)
        spark.conf.set("spark.barline.measureBytes", "0")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    bad = 0
    for name, entry in load().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t0 = time.time()
        try:
            status, n, spent, msg = compare(entry, spark, con, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            status, n, spent, msg = "ERR", 0, 0.0, f"{type(e).__name__}: {str(e)[:600]}"
        if status in ("DIFF", "ERR", "COLS"):
            bad += 1
        empty = " EMPTY" if n == 0 and status in ("ok", "rows") else ""
        print(f"{status:5} {name:34} rows={n:<7} {spent:6.2f}s total={time.time() - t0:5.2f}s{empty} {msg}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
