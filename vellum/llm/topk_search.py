"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights: a component is a term, a candidate block keeps
one posting list (row, weight) per term. A query row walks its own terms and scatters
``query weight * posting weight`` into a dense score array over the block; partition
selection keeps the block's best ``k`` and a window merges the blocks. Every candidate is
scored, nothing is pruned.

Work is dealt in (query block, candidate block) pairs of bounded size: a candidate row is
moved once per ``QUERY_BLOCK`` queries and a query row once per ``CAND_BLOCK`` candidates.

Defined results: vectors that are null, or hold a null or non-finite component, take no part;
components missing in the shorter of two vectors count as 0, an empty vector scores 0;
repeated query ids are one query (the smallest vector); rows with the query's own id are
never its candidates; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAND_BLOCK = 4096
QUERY_BLOCK = 1024
_STRIP = 32  # queries whose score arrays are held at once


def quantise(vector: str | Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of every component as longs; null if a component is null or not finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _blocks(n_rows: int, size: int) -> int:
    return max(1, -(-n_rows // size))


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero components of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.asarray(column.value_lengths().fill_null(0))
    row = np.repeat(np.arange(len(column)), lengths)
    first = np.cumsum(lengths) - lengths
    term = np.arange(len(flat)) - first[row] if len(flat) else np.zeros(0, np.int64)
    used = flat != 0
    return row[used], term[used], flat[used]


class Postings:
    """Posting lists of one candidate block: for each term its rows and weights."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.ids, self.row, self.weight = ids, row[order], weight[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.bounds = np.append(first, len(order))

    def scores(self, n_queries: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Dense scores (queries x rows) of sparse query rows, one term after the other."""
        acc = np.zeros((n_queries, len(self.ids)), np.int64)
        order = np.argsort(term, kind="stable")
        row, term, weight = row[order], term[order], weight[order]
        mine, first = np.unique(term, return_index=True)
        ends = np.append(first[1:], len(term))
        place = np.searchsorted(self.terms, mine)
        for t, lo, hi in zip(place, first, ends, strict=True):
            if t < len(self.terms) and self.terms[t] == term[lo]:
                a, b = self.bounds[t], self.bounds[t + 1]
                product = weight[lo:hi, None] * self.weight[None, a:b]
                if b - a == len(self.ids):
                    acc[row[lo:hi]] += product  # a full posting list holds every row once, in order
                else:
                    acc[row[lo:hi, None], self.row[None, a:b]] += product
        return acc


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Rows of the k best scores (ties to the smaller id), without the query's own rows."""
    allowed = np.flatnonzero(ids != own)
    s = scores[allowed]
    if len(s) > k:
        kth = np.partition(s, len(s) - k)[len(s) - k]
        near = np.flatnonzero(s >= kth)
        allowed, s = allowed[near], s[near]
    return allowed[np.lexsort((ids[allowed], -s))[:k]]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "vector") -> DataFrame:
    """``query_id, rank, <id_col>, score``: each query's ``k`` best candidates (all, if fewer).

    ``rows`` and ``queries`` carry ``id_col`` and integer arrays ``vector`` (see ``quantise``).
    """
    cand = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    query = (queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
             .groupBy("id").agg(F.min("v").alias("v")))
    n_c, n_q = _blocks(cand.count(), CAND_BLOCK), _blocks(query.count(), QUERY_BLOCK)

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["id"].to_numpy()
        block = Postings(ids, *_rows(left["v"]))
        q_ids = right["id"].to_numpy()
        row, term, weight = _rows(right["v"])
        out: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, len(q_ids) if len(ids) else 0, _STRIP):
            hi = min(lo + _STRIP, len(q_ids))
            a, b = np.searchsorted(row, [lo, hi])
            acc = block.scores(hi - lo, row[a:b] - lo, term[a:b], weight[a:b])
            for i in range(hi - lo):
                best = _best(ids, acc[i], q_ids[lo + i], k)
                out.append((np.full(len(best), q_ids[lo + i]), ids[best], acc[i][best]))
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ([], [], []))]
        return pa.table({"query_id": cols[0], id_col: cols[1], "score": cols[2]})

    found = (dealt(cand, "cb", n_c, "qb", n_q).groupBy("qb", "cb")
             .cogroup(dealt(query, "qb", n_q, "cb", n_c).groupBy("qb", "cb"))
             .applyInArrow(search, f"query_id long, `{id_col}` long, score long"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), id_col, "score"))
