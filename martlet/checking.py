"""Run a registered query and its SQL oracle side by side and compare them:
row count, column names, and the multiset of rows (order-insensitive)."""

from __future__ import annotations

import datetime as _dt
import decimal
import math

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def duckdb_connection(sf_dir: str):
    import os

    import duckdb
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        path = f"{sf_dir.rstrip('/')}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


EXACT = False


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if EXACT else float(f"{v:.12g}")
    if isinstance(v, decimal.Decimal):
        return float(v) if EXACT else float(f"{float(v):.12g}")
    if isinstance(v, _dt.datetime):
        return v.isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _key(row):
    return tuple((x is None, "" if x is None else str(type(x).__name__), x if x is not None else 0)
                 for x in row)


def compare(spark_df, con, sql: str) -> dict:
    """Return a report dict with ``match`` plus details on any difference."""
    s_cols = list(spark_df.columns)
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    o_cols = [d[0] for d in rel.description]
    o_rows = rel.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(o_rows),
           "columns_match": sorted(s_cols) == sorted(o_cols)}
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, o_cols
        out["match"] = False
        return out
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    oi = [o_cols.index(c) for c in order]
    s_norm = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=_key)
    o_norm = sorted((tuple(_norm(r[i]) for i in oi) for r in o_rows), key=_key)
    out["values_match"] = s_norm == o_norm
    if not out["values_match"]:
        diffs = []
        for a, b in zip(s_norm, o_norm):
            if a != b:
                diffs.append({c: (x, y) for c, x, y in zip(order, a, b) if x != y})
                if len(diffs) >= 3:
                    break
        out["first_diffs"] = diffs
    out["match"] = out["columns_match"] and out["values_match"] and len(s_rows) == len(o_rows)
    return out
