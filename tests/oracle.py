"""Compare queries with their SQL run by DuckDB on the same files."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, (bool, int)):
        return (1, float(v))
    if hasattr(v, "as_tuple"):
        return (1, float(v))
    if isinstance(v, float):
        return (1, v + 0.0)
    return (2, str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else what differs."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    off = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(off)} of {len(a)} rows differ, first {off[0]}" if off else None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from ringfence.session import build_session

    sf, only = sys.argv[1], sys.argv[2:]
    spark = build_session("check", master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), oracle_sql(), []
    for name, fn in queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                verdict = compare(df, con, sqls[name])
            else:
                n = df.count()
                verdict = None if n else "no rows"
            kind = "sql" if name in sqls else "rows"
        except Exception as e:  # noqa: BLE001
            verdict, kind = f"{type(e).__name__}: {str(e)[:600]}", "error"
        if verdict:
            bad.append(name)
        print(f"{'ok ' if not verdict else 'BAD'} {kind:5s} {time.time() - t:6.2f}s {name} {verdict or ''}", flush=True)
    print(len(bad), "bad:", bad)
