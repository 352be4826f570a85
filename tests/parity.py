"""Compare registered Spark queries with their DuckDB oracle.

Usable from pytest (``tests/test_parity.py``) and as a script:
``python tests/parity.py [sf_dir] [query ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from hushwin.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return round(v, 9)
    if isinstance(v, bool):
        return int(v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in row)


def compare(spark, sf_dir: str, name: str, query, sql: str) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    cols = sorted(sdf.columns)
    srows = [tuple(_norm(r[c]) for c in cols) for r in sdf.collect()]
    t1 = time.time()
    con = duck(sf_dir)
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows_raw = rel.fetchall()
    t2 = time.time()
    res = {"name": name, "spark_rows": len(srows), "oracle_rows": len(drows_raw),
           "spark_s": round(t1 - t0, 2), "oracle_s": round(t2 - t1, 2)}
    if sorted(dcols) != cols:
        res.update(ok=False, why=f"columns differ: spark={cols} oracle={sorted(dcols)}")
        return res
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(_norm(r[i]) for i in idx) for r in drows_raw]
    srows.sort(key=_key)
    drows.sort(key=_key)
    if srows != drows:
        diff = [(a, b) for a, b in zip(srows, drows) if a != b][:3]
        res.update(ok=False, why=f"values differ, first: {diff}")
        return res
    res["ok"] = True
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import __spark_entry__ as E
    from hushwin.session import build_session
    spark = build_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, q in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            df = q(spark, sf_dir)
            print(f"{name:28s} NO-ORACLE rows={df.count()}", flush=True)
            continue
        try:
            r = compare(spark, sf_dir, name, q, sqls[name])
        except Exception as e:  # report and go on
            r = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:400]}"}
        bad += not r["ok"]
        print(f"{name:28s} {'OK ' if r['ok'] else 'BAD'} {r}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
