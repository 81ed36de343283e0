"""Runs registered queries against their SQL: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, name: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if name not in ORACLE:
        return f"rows  {name}: {len(got)} rows, {spent:.1f}s"
    start = time.time()
    rel = con.sql(ORACLE[name])
    want = rows_of(rel.columns, rel.fetchall())
    theirs = time.time() - start
    if sorted(df.columns) != sorted(rel.columns):
        return f"FAIL  {name}: columns {sorted(df.columns)} / {sorted(rel.columns)}"
    kinds = dict(df.dtypes)
    note = ""
    for c, t in zip(rel.columns, rel.types):
        pair = (kinds[c], str(t))
        same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
        if same.get(pair[0]) != pair[1]:
            note += f" type {c} {pair[0]}/{pair[1]}"
    if got == want:
        return f"ok    {name}: {len(got)} rows, {spent:.1f}s / {theirs:.1f}s{note}"
    left = [r for r in got if r not in set(want)][:3]
    right = [r for r in want if r not in set(got)][:3]
    return f"FAIL  {name}: {len(got)} / {len(want)} rows, {spent:.1f}s{note}\n   spark {left}\n   sql   {right}"


def main() -> None:
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if len(sys.argv) < 3 or any(n.startswith(p) for p in sys.argv[2:])]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    con = connect(sf)
    for name in names:
        try:
            print(compare(spark, con, sf, name), flush=True)
        except Exception as e:
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:700]}", flush=True)


if __name__ == "__main__":
    main()
