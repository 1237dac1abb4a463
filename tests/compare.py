"""Run registered queries next to their SQL and report differences.

    python tests/compare.py [--sf DIR] [--rows-per-task N] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if isinstance(df[c].dtype, (pd.Int64Dtype, pd.Int32Dtype)):
            df[c] = df[c].astype("float64")
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v)
    keys = [df[c].astype(str) if df[c].dtype.kind not in "f" else df[c].round(9) for c in df.columns]
    order = pd.concat(keys, axis=1).sort_values(list(df.columns), kind="stable").index if len(df.columns) else df.index
    return df.loc[order].reset_index(drop=True)


def difference(a: pd.DataFrame, b: pd.DataFrame) -> str | None:
    """None when equal; otherwise what differs (a: Spark, b: SQL)."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = tidy(a), tidy(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if len(a) and x.dtype.kind != y.dtype.kind:
            return f"{c}: type {x.dtype} vs {y.dtype}"
        if len(a) and x.dtype != y.dtype and x.dtype.kind in "iuf":
            return f"{c}: width {x.dtype} vs {y.dtype}"
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = int(np.argmin(same.to_numpy()))
            return f"{c}: {int((~same).sum())} differ, first {x[i]!r} vs {y[i]!r} in {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


def main() -> None:
    from plantwatch.plans.catalog import CHECKS, QUERIES
    from plantwatch.session import ROWS_PER_TASK_KEY, build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--rows-per-task", type=int)
    a = ap.parse_args()
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    if a.rows_per_task:
        spark.conf.set(ROWS_PER_TASK_KEY, str(a.rows_per_task))
    con, bad = duck(a.sf), []
    for name in a.names or list(QUERIES):
        t0 = time.time()
        try:
            got = QUERIES[name](spark, a.sf).toPandas()
            t1 = time.time()
            diff = difference(got, con.execute(CHECKS[name]).df()) if name in CHECKS else "(no SQL)"
        except Exception as e:  # noqa: BLE001
            t1, diff, got = time.time(), f"{type(e).__name__}: {str(e)[:1500]}", []
        if diff and diff != "(no SQL)":
            bad.append(name)
        print(f"{'ok  ' if diff is None else 'ROWS' if diff == '(no SQL)' else 'BAD '} {name:28s} {t1 - t0:6.2f}s rows={len(got)} {diff or ''}", flush=True)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
