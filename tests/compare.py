"""Run registered queries and their oracle SQL side by side.

    python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else float(f"{v:.12g}")
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows-only {len(got)}" if got else "rows-only EMPTY"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} vs {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return f"row count {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"first difference {x} vs {y}; {sum(p != q for p, q in zip(a, b))} of {len(a)} rows"
    return None


def main():
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    from peakloom.plans import catalog

    spark, sf_dir = session(), f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    for name, fn in catalog.QUERIES.items():
        if args[1:] and not any(name.startswith(a) for a in args[1:]):
            continue
        t = time.time()
        try:
            result = compare(spark, con, sf_dir, name, fn, catalog.ORACLES.get(name))
        except Exception as e:  # report and go on with the next query
            result = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{time.time() - t:6.1f}s {name}: {result or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
