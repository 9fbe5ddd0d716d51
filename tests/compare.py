"""Run registered queries next to their oracle SQL and compare all values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.plans import ORACLES, QUERIES  # noqa: E402
from millrace.plans.inputs import BASE  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """One form per value, whatever engine it came from."""
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(value).isoformat()
    if isinstance(value, bool) or not isinstance(value, int):
        return value.isoformat() if isinstance(value, dt.date) else value
    return value


def rows(frame_rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in frame_rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def spark_rows(df) -> list[tuple]:
    return rows([tuple(r) for r in df.collect()], df.columns)


def oracle_rows(con, key) -> tuple[list[str], list[tuple]]:
    result = con.execute(ORACLES[key])
    columns = [d[0] for d in result.description]
    return sorted(columns), rows(result.fetchall(), columns)


def compare(spark, con, key: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = QUERIES[key](spark, sf_dir)
    got = spark_rows(df)
    if key not in ORACLES:
        return None if got else "no rows"
    columns, want = oracle_rows(con, key)
    if sorted(df.columns) != columns:
        return f"columns {sorted(df.columns)} != {columns}"
    if len(got) != len(want):
        return f"{len(got)} rows, oracle has {len(want)}; e.g. {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None


if __name__ == "__main__":
    from millrace.session import build_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con, bad = build_session("local[8]"), connect(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for key in chosen:
        began = time.time()
        try:
            problem = compare(spark, con, key, sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - began:6.2f}s {key} {problem or ''}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} equal")
