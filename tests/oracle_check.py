"""Spark-vs-DuckDB comparison of registered queries (row count, column names,
order-insensitive values). Usable from pytest and as a script:

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(float(v))
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> dict:
    df = query(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    sc, sr = _rows(s_cols, s_rows)
    dc, dr = _rows(d_cols, d_rows)
    out = {"name": name, "spark_rows": len(sr), "duck_rows": len(dr), "cols_ok": sc == dc,
           "values_ok": sr == dr}
    if not out["cols_ok"]:
        out["spark_cols"], out["duck_cols"] = sc, dc
    elif not out["values_ok"]:
        sset, dset = set(sr), set(dr)
        out["only_spark"] = sorted(sset - dset)[:3]
        out["only_duck"] = sorted(dset - sset)[:3]
        out["cols"] = sc
    return out


def main(argv):
    import time
    from __spark_entry__ import oracle_sql, queries
    from breachlens.session import get_spark
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or sorted(queries())
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for n in names:
        t = time.time()
        if n not in os_:
            df = qs[n](spark, sf_dir)
            print(f"{n:28s} rows-only {df.count():>7d} rows  {time.time() - t:5.1f}s", flush=True)
            continue
        try:
            r = compare(spark, con, n, qs[n], os_[n], sf_dir)
        except Exception as e:  # report and continue
            bad += 1
            print(f"{n:28s} ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)
            continue
        ok = r["cols_ok"] and r["values_ok"] and r["spark_rows"] == r["duck_rows"]
        bad += not ok
        print(f"{n:28s} {'OK ' if ok else 'BAD'} {r['spark_rows']:>7d}/{r['duck_rows']:<7d} {time.time() - t:5.1f}s"
              + ("" if ok else f"  {r}"), flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
