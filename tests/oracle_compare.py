"""Run registered queries in Spark and their SQL twins in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Compares row count, column names and the sorted multiset of rows exactly.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(v)
    if hasattr(v, "item"):
        return v.item()
    return v


def rows_of(records, cols):
    return sorted((tuple(norm(r[c]) for c in cols) for r in records), key=repr)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT",
                 "tinyint": "TINYINT"}


def compare(spark, con, sf_dir, name, q, sql):
    t0 = time.time()
    sdf = q(spark, sf_dir)
    srows = [r.asDict() for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    dcols = list(rel.columns)
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
    scols = sorted(sdf.columns)
    if scols != sorted(dcols):
        return False, f"columns differ: spark={sorted(sdf.columns)} duck={sorted(dcols)}", t1 - t0
    bad = [(f.name, f.dataType.simpleString(), dtypes[f.name]) for f in sdf.schema.fields
           if SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
           != dtypes[f.name]]
    if bad:
        return False, f"types differ: {bad}", t1 - t0
    if len(srows) != len(drows):
        return False, f"row count spark={len(srows)} duck={len(drows)}", t1 - t0
    a, b = rows_of(srows, scols), rows_of(drows, scols)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ (first): {diff}", t1 - t0
    return True, f"{len(srows)} rows", t1 - t0


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from rarefy.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, q in qs.items():
        if names and name not in names:
            continue
        if name not in sqls:
            t0 = time.time()
            n = q(spark, sf_dir).count()
            print(f"ROWS  {name:28s} {n} rows ({time.time() - t0:.1f}s, no oracle)")
            continue
        try:
            ok, msg, dt = compare(spark, con, sf_dir, name, q, sqls[name])
        except Exception as e:  # noqa: BLE001
            ok, msg, dt = False, f"error: {type(e).__name__}: {str(e)[:400]}", 0.0
        bad += not ok
        print(f"{'OK' if ok else 'FAIL':5s} {name:28s} {msg} ({dt:.1f}s)", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
