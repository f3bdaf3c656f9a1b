"""Compare each registered query with its DuckDB oracle (order-insensitive).

    python tests/oracle_compare.py [sf_dir] [key ...]
"""
from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr), [columns[i] for i in order]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    s_sorted, s_cols = rows_of(sdf.columns, srows)
    if sql is None:
        return dict(key=key, ok=None, rows=len(srows), secs=round(t1 - t0, 2), note="no oracle")
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    d_sorted, d_cols = rows_of(dcols, drows)
    ok = s_cols == d_cols and len(s_sorted) == len(d_sorted) and s_sorted == d_sorted
    note = ""
    if s_cols != d_cols:
        note = f"cols spark={s_cols} duck={d_cols}"
    elif len(s_sorted) != len(d_sorted):
        note = f"rows spark={len(s_sorted)} duck={len(d_sorted)}"
    elif not ok:
        diff = [(a, b) for a, b in zip(s_sorted, d_sorted) if a != b][:2]
        note = f"values differ e.g. {diff}"
    return dict(key=key, ok=ok, rows=len(srows), secs=round(t1 - t0, 2), note=note)


def main(argv):
    from tableprep.session import local_session
    import __spark_entry__ as E

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for k in (keys or list(qs)):
        try:
            r = compare(spark, con, k, qs[k], sqls.get(k), sf_dir)
        except Exception as e:  # report and continue
            r = dict(key=k, ok=False, note=f"{type(e).__name__}: {str(e)[:300]}")
        bad += r["ok"] is False
        print(r, flush=True)
    print("FAILED", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
