"""Compare every query with its SQL: python check_queries.py [folder] [name prefix ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from zonetide.plans.catalogue import catalogue
from zonetide.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, int):
        return float(v)
    return v


def table_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main(folder: str, wanted: list[str]) -> int:
    spark = local_session("check", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    bad = 0
    for name, q in catalogue().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = q.build(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if q.sql is None:
                print(f"rows  {name}: {len(rows)} in {took:.1f}s")
                continue
            cur = con.execute(q.sql)
            names = [d[0] for d in cur.description]
            want = cur.fetchall()
            a, b = table_of(rows, df.columns), table_of(want, names)
            if sorted(df.columns) != sorted(names):
                bad += 1
                print(f"BAD   {name}: columns {sorted(set(df.columns) ^ set(names))}")
            elif a != b:
                bad += 1
                print(f"BAD   {name}: {len(a)} rows against {len(b)}; columns {sorted(names)}")
                for x, y in [(x, y) for x, y in zip(a, b) if x != y][:3]:
                    print("   spark", x)
                    print("   sql  ", y)
            else:
                print(f"ok    {name}: {len(rows)} in {took:.1f}s")
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:700]}")
        sys.stdout.flush()
    print("bad", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(1 if main(args[0] if args else "/root/testdata/sf0.01", args[1:]) else 0)
