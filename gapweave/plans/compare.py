"""Run registered queries next to their check SQL (used by tests and by hand)."""

from __future__ import annotations

import math
import time


def duck(sf: str):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in sorted(glob.glob(f"{sf}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.9g}"
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    return str(v)


def rows_of(cols: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def check(spark, con, sf: str, name: str, fn, text: str | None) -> dict:
    start = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    out = {"name": name, "sec": round(took, 2), "rows": len(got), "ok": None, "note": ""}
    if text is None:
        return out
    cur = con.execute(text)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    out["duck_sec"] = round(time.time() - start - took, 2)
    if sorted(cols) != sorted(df.columns):
        out.update(ok=False, note=f"columns {sorted(df.columns)} vs {sorted(cols)}")
        return out
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    out["ok"] = a == b
    if not out["ok"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        out["note"] = f"{len(a)} vs {len(b)} rows; first differences {diff}"
    return out
