"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
Prints one line per query: OK / MISMATCH / ERROR / ROWS (no oracle).
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


STRICT = os.environ.get("STRICT") == "1"   # exact float equality, as a value hash would see it


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        if STRICT:
            return repr(v + 0.0)
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return repr(v)


SPARK_TO_DUCK = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "bigint": "BIGINT",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "array<double>": "DOUBLE[]",
                 "array<string>": "VARCHAR[]", "float": "FLOAT"}


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return "ROWS", f"{len(srows)} rows spark {t1 - t0:.2f}s"
    res = con.sql(sql)
    dcols = list(res.columns)
    dtypes = dict(zip(dcols, [str(t) for t in res.types]))
    wrong = [(c, t, dtypes.get(c)) for c, t in df.dtypes if SPARK_TO_DUCK.get(t, t) != dtypes.get(c)]
    if wrong:
        return "MISMATCH", f"types (column, spark, duckdb): {wrong}"
    drows = res.fetchall()
    sc, sr = canon(df.columns, srows)
    dc, dr = canon(dcols, drows)
    if sc != dc:
        return "MISMATCH", f"columns spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return "MISMATCH", f"rows spark={len(sr)} duck={len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return "MISMATCH", f"{len(bad)} rows differ, e.g. spark={bad[0][0]} duck={bad[0][1]}"
    return "OK", f"{len(sr)} rows spark {t1 - t0:.2f}s"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    from loadstats.session import get_spark
    import __spark_entry__ as entry
    spark = get_spark(os.environ.get("CHECK_MASTER", "local[8]"), 8)
    con = duck(sf_dir)
    qs = entry.queries()
    oracles = entry.oracle_sql()
    counts = {}
    for name, fn in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            status, msg = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            status, msg = "ERROR", f"{type(exc).__name__}: {str(exc)[:300]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        counts[status] = counts.get(status, 0) + 1
        print(f"{status:8s} {name}: {msg}", flush=True)
    print("SUMMARY", counts)


if __name__ == "__main__":
    main()
