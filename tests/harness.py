"""Runs queries and their SQL side by side: names, row counts and values, columns by name, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if v == 0 else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(c, sql: str):
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


def difference(spark, sf_dir: str, query, sql: str, c=None) -> str:
    names, ours = rows_of_spark(query(spark, sf_dir))
    sql_names, theirs = rows_of_sql(c or connect(sf_dir), sql)
    if names != sql_names:
        return f"columns {names} against {sql_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}; {[x for x in ours if x not in set(theirs)][:3]} {[x for x in theirs if x not in set(ours)][:3]}"
    odd = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b and not all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b, strict=True))]
    return f"{len(odd)} rows differ: {odd[:2]}" if odd else ""


if __name__ == "__main__":
    import importlib

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from tests.conftest import session

    spark, sf = session(4), sys.argv[1]
    q, s = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or [n for n in q if not n.startswith(("op", "pipeline"))]:
        try:
            if name not in s:
                print("rows", name, q[name](spark, sf).count(), flush=True)
                continue
            why = difference(spark, sf, q[name], s[name], connect(sf))
            print("ok" if not why else "DIFFERS", name, why[:700], flush=True)
        except Exception as x:
            print("ERROR", name, str(x)[:600].replace("\n", " "), flush=True)
    importlib.invalidate_caches()
