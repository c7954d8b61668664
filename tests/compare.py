"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        cells = [None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA else v for v in df[c].tolist()]
        out[c] = pd.Series([float(v) if isinstance(v, float) else v for v in cells], dtype=object)
    df = pd.DataFrame(out, dtype=object)
    keys = df.map(lambda v: ("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)))
    return df.loc[keys.sort_values(list(df.columns)).index].reset_index(drop=True)


def differences(spark_df, con, sql: str) -> list[str]:
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    out = []
    for c in sorted(got.columns):
        kinds = [
            "f" if pd.api.types.is_float_dtype(d[c]) else "b" if pd.api.types.is_bool_dtype(d[c]) else "i"
            if pd.api.types.is_integer_dtype(d[c]) else "o"
            for d in (got, want)
        ]
        if kinds[0] != kinds[1] and len(got) and not got[c].isna().any():
            out.append(f"type of {c}: {got[c].dtype} != {want[c].dtype}")
    a, b = normal(got), normal(want)
    for c in a.columns:
        bad = [i for i in range(len(a)) if a[c][i] != b[c][i]]
        if bad:
            i = bad[0]
            out.append(f"{c}: {len(bad)} of {len(a)} differ, first {a.loc[i].to_dict()} != {b.loc[i].to_dict()}")
    return out
