"""Run a named query on Spark and its SQL on DuckDB and compare the rows.

``python tests/compare.py [sf folder] [name ...]`` reports every query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tablelore.registry import all_queries  # noqa: E402
from tablelore.registry.base import TABLES  # noqa: E402


def plain(value):
    """One form for values that print differently in the two engines."""
    if isinstance(value, decimal.Decimal):
        value = float(value) if value != int(value) else int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.10g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows))


def duck(sf: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


_KINDS = {"int": "int", "bigint": "bigint", "double": "double", "string": "varchar",
          "boolean": "boolean", "timestamp_ntz": "timestamp", "timestamp": "timestamp",
          "date": "date"}


def compare(spark, con, sf: str, name: str):
    """(ok, message) for one query."""
    q = all_queries()[name]
    df = q.run(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if q.sql is None:
        return bool(got), f"{len(got)} rows, no SQL"
    cur = con.execute(q.sql)
    columns = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]).lower() for d in cur.description}
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns differ: spark {sorted(df.columns)} sql {sorted(columns)}"
    odd = []
    for f in df.schema.fields:
        a, b = _KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()), types[f.name]
        b = {"integer": "int"}.get(b, b)
        if a != b and not (a == "timestamp" and "time" in b):
            odd.append(f"{f.name} {a}/{b}")
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        return False, f"{len(a)} / {len(b)} rows\n   spark {only_a}\n   sql   {only_b}"
    return not odd, f"{len(a)} rows" + (f"; types differ: {odd}" if odd else "")


if __name__ == "__main__":
    from tablelore.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(all_queries())
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    bad = 0
    for query_name in wanted:
        started = time.time()
        try:
            ok, message = compare(session, connection, folder, query_name)
        except Exception as error:  # report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {query_name} {time.time() - started:.1f}s "
              f"{message}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
