"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reuse(df: DataFrame) -> DataFrame:
    """Persist an aggregated table that several actions read (scalar summaries and the
    main plan), so the scan below it runs once. Memory-and-disk: a lost executor's
    blocks are recomputed from lineage, so results never depend on the cache."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the table is counted to have at most ``max_rows`` rows;
    otherwise return it as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def scalar(df: DataFrame, expr: Column):
    """One summary value of a (small, aggregated) table."""
    return df.select(expr).first()[0]


def key_hash(col) -> Column:
    """First 32 bits of md5(key) as a non-negative long; DuckDB computes the same value."""
    c = F.col(col) if isinstance(col, str) else col
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def unit_hash(*parts) -> Column:
    """Deterministic uniform value in [0, 1) from md5 of ``:``-joined parts."""
    return key_hash(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])) / F.lit(float(1 << 32))
