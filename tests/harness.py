"""Compare a Spark query with its DuckDB SQL twin (order-insensitive)."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from tablewright.sources.tables import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v


def rows_of(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (x is pd.NaT) or (not isinstance(x, (list, tuple, dict)) and pd.isna(x)) else x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_df, sql: str, sf_dir: str, con=None):
    con = con or duck(sf_dir)
    s = spark_df.toPandas()
    d = con.execute(sql).fetchdf()
    sc, sr = rows_of(s)
    dc, dr = rows_of(d)
    problems = []
    if sc != dc:
        problems.append(f"columns differ: spark={sc} duck={dc}")
    if len(sr) != len(dr):
        problems.append(f"row counts differ: spark={len(sr)} duck={len(dr)}")
    if not problems:
        bad = [(a, b) for a, b in zip(sr, dr) if a != b]
        if bad:
            problems.append(f"{len(bad)} rows differ, first: spark={bad[0][0]} duck={bad[0][1]}")
    return problems, len(sr)
