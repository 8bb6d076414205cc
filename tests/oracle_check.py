"""Compare registered queries with their SQL twins: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from __spark_entry__ import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    return v


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    values = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(values, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(df, con, sql: str) -> str:
    """Empty when equal, else the first difference."""
    got_cols, got = _table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = _table([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    for g, w in zip(got, want):
        if g != w:
            return f"{got_cols}: {g} != {w}"
        if [type(a) for a in g] != [type(b) for b in w]:
            return f"types of {g} and {w} differ"
    return ""


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con, twins = session(), connect(sf), oracle_sql()
    bad = 0
    for name, q in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = q(spark, sf)
            if name in twins:
                problem = compare(df, con, twins[name])
                state = "DIFFERS " + problem[:600] if problem else "equal"
            else:
                state = f"rows {df.count()} {df.columns}"
        except Exception as e:
            state = "FAILED " + str(e)[:1200]
        bad += state.startswith(("DIFFERS", "FAILED"))
        print(f"{name:24s} {time.time() - start:7.2f}s {state}", flush=True)
        spark.catalog.clearCache()
    print("problems:", bad)
