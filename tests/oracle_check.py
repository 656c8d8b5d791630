"""Compare registered queries with their SQL counterparts: ``python tests/oracle_check.py [-s sf] [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if s.dtype == object:
            df[c] = s.map(lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
        elif str(s.dtype).startswith("datetime"):
            df[c] = s.astype("datetime64[us]").astype(str).replace("NaT", None)
        elif s.dtype == bool:
            df[c] = s.astype(object)
        else:
            df[c] = pd.to_numeric(s).astype("float64")
    keys = list(df.columns)
    return df.sort_values(keys, key=lambda s: s.round(4) if s.dtype == "float64" else s.astype(str)).reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame, tol: float = 1e-9) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype == "float64" and y.dtype == "float64":
            bad = ~((x == y) | (x.isna() & y.isna()) | (abs(x - y) <= tol * np.maximum(1, abs(y))))
        else:
            x, y = x.astype(object).where(x.notna(), None), y.astype(object).where(y.notna(), None)
            bad = pd.Series([p != q for p, q in zip(x, y)])
        if bad.any():
            k = int(np.argmax(bad.to_numpy()))
            return f"{int(bad.sum())} values differ in {c}, e.g.\n   got  {a.iloc[k].to_dict()}\n   want {b.iloc[k].to_dict()}"
    return ""


def type_notes(got, con, sql: str) -> str:
    """Type families that differ (a hash over values may care)."""
    want = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    family = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
              "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    return ", ".join(f"{n}:{t}/{want.get(n)}" for n, t in got.dtypes if family.get(t) != want.get(n))


def main() -> int:
    from tickloom.session import local_session
    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    if args[:1] == ["--plain"]:  # a session that knows nothing of this library's settings
        from pyspark.sql import SparkSession
        args = args[1:]
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session()
    con = connect(sf_dir)
    queries, oracle = e.queries(), e.oracle_sql()
    names = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    failed = 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = df.toPandas()
            t1 = time.time()
            if name not in oracle:
                print(f"rows  {name} {len(got)} {t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(oracle[name]).df()
            problem = compare(got, want)
            notes = type_notes(df, con, oracle[name])
            print(f"{'FAIL' if problem else 'ok  '}  {name} rows={len(got)} {t1 - t0:.1f}s sql={time.time() - t1:.1f}s {problem} {('types ' + notes) if notes else ''}", flush=True)
            failed += bool(problem)
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            failed += 1
            print(f"ERROR {name} {type(exc).__name__}: {str(exc)[:600]}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
