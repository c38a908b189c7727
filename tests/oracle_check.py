"""Compare registered queries with their SQL checks: python tests/oracle_check.py FOLDER [names]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as registry  # noqa: E402
from chunkloom.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, folder):
    started = time.time()
    df = registry.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - started
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return "rows", len(got[1]), seconds, ""
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    if got == want:
        return "same", len(got[1]), seconds, ""
    note = f"columns {got[0]} / {want[0]}" if got[0] != want[0] else ""
    if not note:
        left, right = set(map(repr, got[1])), set(map(repr, want[1]))
        note = f"rows {len(got[1])} / {len(want[1])}\n   only spark {sorted(left - right)[:3]}\n   only sql   {sorted(right - left)[:3]}"
    return "DIFF", len(got[1]), seconds, note[:1500]


if __name__ == "__main__":
    folder = sys.argv[1]
    names = sys.argv[2:] or list(registry.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            status, n, seconds, note = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            status, n, seconds, note = "FAIL", 0, 0.0, str(error)[:1200]
        bad += status in ("DIFF", "FAIL")
        print(f"{status:5} {name:28} rows={n:<7} {seconds:6.2f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    sys.exit(1 if bad else 0)
