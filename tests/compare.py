"""Runs queries on Spark and their SQL twins on DuckDB and compares the rows.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark, con, name, fn, sql, folder):
    """(problem or None, rows, seconds)"""
    began = time.time()
    df = fn(spark, folder)
    rows = df.collect()
    took = time.time() - began
    if sql is None:
        return None, len(rows), took
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    types = {d[0]: str(d[1]) for d in cur.description}
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", len(rows), took
    for c, k in df.dtypes:
        if KINDS.get(k, k).lower() != types[c].lower():
            return f"type of {c}: {k} vs {types[c]}", len(rows), took
    a, b = normal(df.columns, [tuple(r) for r in rows]), normal(cols, theirs)
    if a != b:
        extra = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"rows {len(a)} vs {len(b)}: only spark {extra[0]} / only sql {extra[1]}", len(rows), took
    return None, len(rows), took


def main(argv):
    import __spark_entry__ as entry
    from gridlore.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="12g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    wanted = argv[1:]
    names = [n for n in queries if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    for name in names:
        try:
            problem, n, took = compare(spark, con, name, queries[name], oracle.get(name), folder)
        except Exception as e:  # report and go on
            problem, n, took = f"{type(e).__name__}: {str(e)[:900]}", 0, 0.0
        bad += problem is not None
        kind = "sql " if name in oracle else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:34s} {n:7d} rows {took:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
