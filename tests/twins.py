"""Compare a registered query with its SQL twin: names, row counts and values in any order."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r))
    )


def differences(spark, con, folder, build, sql) -> str:
    """Empty if both sides agree, else what differs."""
    frame = build(spark, folder)
    left = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    right = _rows(names, found.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            bad = [(n, x, y) for n, x, y in zip(sorted(names), a, b) if x != y]
            return f"first difference {str(bad)[:1500]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from shelfloom.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8, shared=os.environ.get("SHARED_DIR", "/tmp/shelfloom-twins"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, twins = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    for name in wanted:
        start = time.time()
        try:
            if name in twins:
                problem = differences(spark, con, folder, queries[name], twins[name])
            else:
                problem = f"rows only: {queries[name](spark, folder).count()}"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok' if not problem else 'DIFF'} {name} {time.time() - start:.1f}s {problem}", flush=True)
    spark.stop()
