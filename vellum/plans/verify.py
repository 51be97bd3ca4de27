"""Side-by-side check of a registered query against its DuckDB oracle SQL."""

from __future__ import annotations

import math
import os

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, tuple, str, bytes)):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if os.environ.get("VELLUM_EXACT") else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool | None, str]:
    """Row count, column names and the multiset of rows (doubles to 5 places); None, not True,
    for a query without an oracle, which is only run."""
    from vellum.plans.catalog import ORACLE, QUERIES
    sdf = QUERIES[name](spark, sf_dir)
    cols = sdf.columns
    rows = [tuple(r) for r in sdf.collect()]
    if name not in ORACLE:
        return None, f"unchecked, {len(rows)} rows (no oracle)"
    res = con.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    if sorted(cols) != sorted(ocols):
        return False, f"columns {cols} vs {ocols}"
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
    a = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in oorder) for r in orows), key=repr)
    if len(a) != len(b):
        return False, f"rows {len(a)} vs oracle {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return False, f"{len(diff)} differing rows, e.g. {diff[:2]}"
    return True, f"{len(a)} rows"
