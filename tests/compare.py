"""Run a registered query and its SQL on the same tables and compare the values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_key(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted(tuple(_key(r[i]) for i in idx) for r in cur.fetchall())


def difference(spark_side, duck_side) -> str | None:
    (sc, sr), (dc, dr) = spark_side, duck_side
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}"
    for a, b in zip(sr, dr):
        if a != b:
            return f"first difference {[(c, x, y) for c, x, y in zip(sc, a, b) if x != y]} in {a}"
    return None
