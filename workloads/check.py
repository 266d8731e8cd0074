"""Run registered queries on a folder and compare each with its SQL in DuckDB.

    python -m workloads.check /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from workloads.catalog import ORACLES, QUERIES


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(value):
    if value is not None and not isinstance(value, (str, int, float, bool)):
        return str(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, folder: str, names: list[str]) -> int:
    con = duckdb.connect()
    for file in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            mine = table(df.columns, df.collect())
        except Exception as error:  # noqa: BLE001
            print(f"{name:28s} SPARK FAILED {str(error)[:700]}")
            bad += 1
            continue
        spent = time.time() - start
        if name not in ORACLES:
            print(f"{name:28s} rows only {len(mine):8d} {spent:6.2f}s")
            continue
        try:
            cursor = con.execute(ORACLES[name])
            columns = [d[0] for d in cursor.description]
            theirs = table(columns, cursor.fetchall())
        except Exception as error:  # noqa: BLE001
            print(f"{name:28s} SQL FAILED {str(error)[:700]}")
            bad += 1
            continue
        same = sorted(columns) == sorted(df.columns) and repr(mine) == repr(theirs)
        print(f"{name:28s} {'ok' if same else 'DIFFERS':8s} {len(mine):8d} {spent:6.2f}s")
        if not same:
            bad += 1
            print("   ", sorted(df.columns), sorted(columns), len(mine), len(theirs))
            for a, b in [p for p in zip(mine, theirs) if repr(p[0]) != repr(p[1])][:3]:
                print("    spark ", a, "\n    duckdb", b)
    return bad


if __name__ == "__main__":
    chosen = sys.argv[2:] or list(QUERIES)
    failures = compare(session(), sys.argv[1], chosen)
    print("failures:", failures)
    sys.exit(1 if failures else 0)
