"""Compares queries with their SQL: python tests/oracle.py [NAME...]"""

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    same = lambda v: round(v, 9) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(same(r[i]) for i in order) for r in data), key=str)


def compare(spark, con, folder, f, sql):
    """None, or what differs."""
    df = f(spark, folder)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows: {got[:2]} {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    kinds = [(a, b) for a, b in zip(got[:1], want[:1]) if [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:3]}" if bad else f"types {kinds}" if kinds else None if got else "no rows"


if __name__ == "__main__":
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = root
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", 4).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    folder = os.environ.get("SF", "/root/testdata/sf0.01")
    con, q, s = connect(folder), e.queries(), e.oracle_sql()
    for name in sys.argv[1:] or [n for n in q if n in s]:
        began = time.time()
        try:
            said = compare(spark, con, folder, q[name], s[name])
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:500]}"
        print(f"{name}: {said or 'ok'} ({time.time() - began:.1f} s)", flush=True)
