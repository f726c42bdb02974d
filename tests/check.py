"""Compare registered queries with their SQL: row count, column names, values in any order."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (float, Decimal)):
        return f"{type(v).__name__}{v!r}"
    return f"{type(v).__name__}{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(name, df, con, sql):
    columns, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    wanted_columns, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} <> {wanted_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} <> {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(bad)} values differ, e.g. {bad[0]}"
    return None if got else "empty"


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from livetables.session import get_session
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                              "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                              "spark.sql.caseSensitive": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    failed = 0
    for n in names:
        t0 = time.time()
        try:
            df = queries[n](spark, sf_dir)
            problem = compare(n, df, con, sql[n]) if n in sql else (f"rows only: {df.count()}")
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None and not problem.startswith("rows only")
        print(f"{'ok  ' if problem is None else 'note' if problem.startswith('rows only') else 'FAIL'} {time.time() - t0:6.2f}s {n} {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main()
