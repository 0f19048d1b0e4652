"""Side-by-side check of registered Spark queries against their DuckDB oracles.

Usage: python -m eventlens.plans.check [sf_dir] [name-substring ...]
"""
from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits: int = 6):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(_norm(x, digits) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(_norm(x, digits) for x in v)
    return v


def canon(cols, rows, digits: int = 6):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(_norm(r[i], digits) for i in order) for r in rows)


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con=None):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["duck_rows"] = len(drows)
    sc, sh = canon(scols, srows)
    dc, dh = canon(dcols, drows)
    if sc != dc:
        res["status"] = f"COLUMNS {sc} vs {dc}"
    elif sh != dh:
        diff_s = list((sh - dh).items())[:3]
        diff_d = list((dh - sh).items())[:3]
        res["status"] = f"VALUES spark-only={diff_s} duck-only={diff_d}"
    else:
        res["status"] = "match"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    pats = argv[2:]
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    from eventlens.session import get_session
    from eventlens.plans import REGISTRY
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, p in REGISTRY.items():
        if pats and not any(x in name for x in pats):
            continue
        try:
            r = compare(spark, sf_dir, name, p.fn, p.oracle, con)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
