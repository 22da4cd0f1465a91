"""Compare queries with their SQL in DuckDB: python tests/oracle.py [FOLDER] [NAME...]."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            path = f"{folder}/{f}"
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else int(x) if x == int(x) and abs(x) < 1e15 else x
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x).replace(" 00:00:00", "")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


def compare(spark, con, folder: str, query, sql: str) -> tuple[bool, str]:
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return False, f"{len(got)} against {len(want)} rows; only Spark {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from plotwise.session import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            if name in sqls:
                ok, what = compare(spark, con, folder, query, sqls[name])
            else:
                ok, what = True, f"{query(spark, folder).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            ok, what = False, f"{type(e).__name__} {str(e)[:400]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, what, f"{time.time() - t:.1f} s", flush=True)
    sys.exit(bad)
