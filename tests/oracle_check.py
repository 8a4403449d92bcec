"""Run registered queries against their SQL twins: python tests/oracle_check.py [--sf 0.01] [name prefixes...]"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import sys
import time
import warnings
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    return type(v).__name__


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark_cols, spark_rows, sql_cols, sql_rows):
    """None when equal, else the first difference."""
    c1, r1 = canonical(spark_cols, spark_rows)
    c2, r2 = canonical(sql_cols, sql_rows)
    if c1 != c2:
        return f"columns {c1} vs {c2}"
    if len(r1) != len(r2):
        extra = sorted(set(r1) - set(r2), key=str)[:3], sorted(set(r2) - set(r1), key=str)[:3]
        return f"rows {len(r1)} vs {len(r2)}; only spark {extra[0]}; only sql {extra[1]}"
    for a, b in zip(r1, r2):
        if a != b:
            return f"value {dict(zip(c1, a))} vs {dict(zip(c2, b))}; {sum(x != y for x, y in zip(r1, r2))} rows differ"
        for x, y in zip(a, b):
            if x is not None and y is not None and kind(x) != kind(y):
                return f"type {kind(x)} vs {kind(y)} in {dict(zip(c1, a))}"
    return None


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def sql_rows(con, text):
    rel = con.sql(text)
    return list(rel.columns), rel.fetchall()


def run_one(spark, con, name, sf_dir, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    if sql is None:
        return len(rows), spent, 0.0, None
    t = time.time()
    cols, expected = sql_rows(con, sql)
    return len(rows), spent, time.time() - t, compare(df.columns, rows, cols, expected)


def main():
    from tidemark.plans import load
    from tidemark.session import build_session

    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    warnings.simplefilter("ignore")
    cat = load()
    sf_dir = f"/root/testdata/sf{a.sf}"
    spark = build_session("oracle-check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = []
    for name, fn in cat.QUERIES.items():
        if a.names and not any(name == n or name.startswith(n + "_") or (n.endswith("*") and name.startswith(n[:-1])) for n in a.names):
            continue
        try:
            n, s1, s2, diff = run_one(spark, con, name, sf_dir, fn, cat.SQL.get(name))
        except Exception as e:  # report and go on
            n, s1, s2, diff = 0, 0, 0, f"{type(e).__name__}: {str(e)[:700]}"
        state = "ok" if diff is None else "BAD"
        if diff is None and n == 0:
            state = "EMPTY"
        print(f"{state:5} {name:34} rows={n:<7} spark={s1:.1f}s sql={s2:.1f}s {'' if name in cat.SQL else '(no sql)'} {diff or ''}", flush=True)
        if state != "ok":
            bad.append(name)
    print("bad:", " ".join(bad) or "none")


if __name__ == "__main__":
    main()
