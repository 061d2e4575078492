"""Compare registered Spark queries against their DuckDB oracle SQL.

Mirrors the driver's check: row count, column names and an order-insensitive
hash of the values.  Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v else str(v)
    return str(v)


def rows_key(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, names=None, verbose=True, plans=None):
    import __spark_entry__ as E
    from cohortforge.session import drop_staged
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = E.queries(), E.oracle_sql()
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        s_cols = df.columns
        s_rows = [tuple(r) for r in df.collect()]
        if plans is not None:
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
        t1 = time.time()
        drop_staged(spark)
        if name not in sqls:
            results[name] = ("rows-only", len(s_rows))
            continue
        cur = con.execute(sqls[name])
        d_cols = [d[0] for d in cur.description]
        d_rows = cur.fetchall()
        ok_cols = sorted(s_cols) == sorted(d_cols)
        ok_n = len(s_rows) == len(d_rows)
        ok_v = ok_cols and rows_key(s_rows, s_cols) == rows_key(d_rows, d_cols)
        results[name] = (ok_cols and ok_n and ok_v, len(s_rows), len(d_rows))
        if verbose:
            print(f"{name:34s} {'OK ' if results[name][0] else 'BAD'} spark={len(s_rows)} duck={len(d_rows)} "
                  f"cols={'ok' if ok_cols else 'DIFF'} {t1 - t0:.1f}s", flush=True)
            if not ok_cols:
                print("   spark-only:", sorted(set(s_cols) - set(d_cols)), "duck-only:", sorted(set(d_cols) - set(s_cols)))
            elif not ok_v:
                a, b = rows_key(s_rows, s_cols), rows_key(d_rows, d_cols)
                sa, sb = set(a), set(b)
                print("   spark-only rows:", list(sa - sb)[:2])
                print("   duck-only rows:", list(sb - sa)[:2])
    return results


if __name__ == "__main__":
    from cohortforge.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] is not True and v[0] != "rows-only"]
    print("BAD:", bad)
