"""Run registered queries beside their SQL twins and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from __spark_entry__ import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(path: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else round(v, 9))
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, (str,)):
        return v
    return float(v) if hasattr(v, "__float__") else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, path, name, fn, sql):
    """None when equal, else what differs."""
    df = fn(spark, path)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, want {len(want[1])}"
    if not want[1]:
        return "no rows on either side"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return None if not bad else f"{len(bad)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}"


if __name__ == "__main__":
    from fleetlens.session import local_session

    path = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(path), oracle_sql(), []
    for name, fn in queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, path, name, fn, sqls.get(name))
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        took = time.time() - start
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {took:6.2f}s {name}{'' if sqls.get(name) else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{len(failed)} failed: {failed}")
