"""Compare every registered query with its SQL: python tests/check_queries.py [sf_dir] [names...]"""

from __future__ import annotations

import datetime
import os
import sys
import tempfile
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("CHECK_STAGES") or tempfile.mkdtemp(prefix="check-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object and df[c].map(lambda v: type(v) is datetime.date).any():
            df[c] = pd.to_datetime(df[c])
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str).str.replace(" 00:00:00", "").replace("NaT", "null")
        elif df[c].map(lambda v: isinstance(v, float)).any():
            df[c] = df[c].map(lambda v: "null" if pd.isna(v) else f"{float(v):.6f}".replace("-0.000000", "0.000000"))
        else:
            df[c] = df[c].map(lambda v: "null" if pd.isna(v) else str(v)).replace("NaT", "null")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    a, b = normal(left), normal(right)
    bad = (a != b).any(axis=1)
    if bad.any():
        return f"{int(bad.sum())} rows differ, e.g.\n{a[bad].head(3).to_string()}\n{b[bad].head(3).to_string()}"
    return None


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = session()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    failed = 0
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        try:
            t0 = time.time()
            got = fn(spark, sf).toPandas()
            t1 = time.time()
            want = con.sql(sql[name]).df() if name in sql else None
            t2 = time.time()
            problem = None if want is None else differences(got, want)
            types = {}
            if want is not None:
                types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got if str(got[c].dtype) != str(want[c].dtype)}
            print(f"{'FAIL' if problem else 'ok  '} {name:24s} rows={len(got):7d} spark={t1 - t0:6.2f}s sql={t2 - t1:6.2f}s {types or ''}", flush=True)
            if problem:
                failed += 1
                print(problem)
        except Exception as e:  # keep going, report at the end
            failed += 1
            print(f"ERR  {name}: {type(e).__name__}: {str(e)[:900]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
