"""Run a Spark query and its DuckDB oracle side by side and compare exactly.

Usage: python tests/oracle_harness.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()[:10] if not isinstance(v, dt.datetime) else v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def rows_key(rows):
    return sorted((tuple("\x00" if x is None else x for x in r) for r in rows))


def compare(spark, sf_dir, df, sql, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    s_cols = df.columns
    s_rows = [tuple(_norm(r[c]) for c in sorted(s_cols)) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    o_cols = [d[0] for d in cur.description]
    o_raw = cur.fetchall()
    idx = [o_cols.index(c) for c in sorted(o_cols)]
    o_rows = [tuple(_norm(r[i]) for i in idx) for r in o_raw]
    res = {"spark_rows": len(s_rows), "oracle_rows": len(o_rows),
           "cols_match": sorted(s_cols) == sorted(o_cols), "spark_s": round(t1 - t0, 2)}
    a, b = rows_key(s_rows), rows_key(o_rows)
    res["values_match"] = a == b
    if not res["cols_match"]:
        res["spark_cols"], res["oracle_cols"] = sorted(s_cols), sorted(o_cols)
    elif a != b:
        sa, sb = set(a), set(b)
        res["only_spark"] = list(sa - sb)[:3]
        res["only_oracle"] = list(sb - sa)[:3]
    return res


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from tidewise.session import get_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(E.queries())
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for k in keys:
        try:
            df = qs[k](spark, sf_dir)
            if k not in os_:
                n = df.count()
                print(f"{k:32s} rows-only {n}")
                continue
            r = compare(spark, sf_dir, df, os_[k], con)
        except Exception as e:  # noqa: BLE001
            r = {"error": repr(e)[:600]}
        ok = r.get("values_match") and r.get("cols_match")
        bad += not ok
        print(f"{k:32s} {'OK ' if ok else 'BAD'} {r}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
