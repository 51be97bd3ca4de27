"""Hard-negative mining by a branch-and-bound scan of vertically stored vectors (BOND).

Vectors are dealt into blocks that store one column per dimension, with the column's least and
greatest value. An anchor reads a block's columns in the order of its own components' size.
After a few columns the part of the score still to come is bounded by the remaining columns'
extremes; rows whose bounds leave every wanted place out of reach lose their bit in the
candidate bitmap, and later columns are read for the surviving rows only. Scores are exact for
all rows that stay.

Two scans: the first finds each anchor's best rows of its own label (positives); their scores
set, for each positive, a window of allowed scores, and the second finds the best rows of other
labels inside each window. Work is dealt in (anchor group, block) pairs of bounded size, so no
label and no vector, however frequent, decides the size of a task; a block moves once per
``ANCHOR_ROWS`` anchors and an anchor once per ``BLOCK_ROWS`` rows.

Defined results: rows without id, label or vector take no part; components missing in the
shorter of two vectors count as 0; rows that repeat an id are one row (the smallest label, then
the smallest vector), and so are repeated anchors; a row is never its own positive or negative;
further columns are ignored; empty tables give empty ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.lineage import materialise

BLOCK_ROWS = 8192
ANCHOR_ROWS = 8192
FIRST_STEP = 8  # columns read before the first pruning; each later step doubles what was read
_EXACT = 1 << 53


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column as one integer matrix, short ones padded with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = np.asarray(vectors.value_lengths()).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _first_of_each(ids: np.ndarray, label: np.ndarray, vectors: pa.Array) -> np.ndarray:
    """Rows to keep, by label and id: one of each id, the smallest label and vector first."""
    order = np.lexsort((label, ids))
    again = np.flatnonzero(ids[order][1:] == ids[order][:-1])
    if len(again):
        keep = {}
        for i in order.tolist():
            key = (int(label[i]), vectors[i].as_py())
            if int(ids[i]) not in keep or key < keep[int(ids[i])][0]:
                keep[int(ids[i])] = (key, i)
        order = np.array([i for _, i in keep.values()], np.int64)
    return order[np.lexsort((ids[order], label[order]))]


def _store_block(rows: pa.Table) -> pa.Table:
    """One vertical block: ids, labels, and the columns one after the other."""
    ids, label, vectors = rows["id"].to_numpy(), rows["label"].to_numpy(), rows["v"].combine_chunks()
    keep = _first_of_each(ids, label, vectors)
    columns = np.ascontiguousarray(_matrix(vectors)[keep].T)
    small = columns.size == 0 or -(1 << 15) <= columns.min() and columns.max() < 1 << 15
    return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int32()), "ids": pa.array([ids[keep].tobytes()]), "labels": pa.array([label[keep].tobytes()]),
                     "small": pa.array([bool(small)]), "columns": pa.array([columns.astype("<i2" if small else "<i8").tobytes()])})


class Block:
    """A vertical block in memory: rows by (label, id), ``columns[d]`` one dimension of all rows."""

    def __init__(self, ids: bytes, labels: bytes, columns: bytes, small: bool):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.columns = np.frombuffer(columns, "<i2" if small else "<i8").reshape(-1, len(self.ids)).astype(np.int64)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)
        self.exact = self.columns.astype(np.float64)  # products in doubles while no sum can pass 2**53
        self.reach = np.maximum(np.abs(self.low), np.abs(self.high)).astype(np.float64)

    def scan(self, q: np.ndarray, rows: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) that ``keep(lower, upper)`` has left of ``rows`` when all columns are read."""
        dims = min(len(q), len(self.columns))
        order = np.argsort(-np.abs(q[:dims]), kind="stable")
        w, low, high = q[order], self.low[order], self.high[order]
        least, most = np.minimum(w * low, w * high), np.maximum(w * low, w * high)
        to_come = np.zeros((2, dims + 1), np.int64)
        to_come[0, :-1], to_come[1, :-1] = np.cumsum(least[::-1])[::-1], np.cumsum(most[::-1])[::-1]
        safe = float(np.abs(w).astype(np.float64) @ self.reach[order]) < _EXACT
        columns, weight = (self.exact, w.astype(np.float64)) if safe else (self.columns, w)
        bitmap = np.zeros(len(self.ids), bool)
        bitmap[rows] = True
        score = np.zeros(len(rows), np.int64)
        read, step = 0, FIRST_STEP
        while read < dims and len(rows):
            to = min(dims, read + step)
            part = columns[order[read:to]]
            part = part if len(rows) == len(self.ids) else part[:, rows]
            score = score + (weight[read:to] @ part).astype(np.int64)
            read, step = to, to
            left = keep(score + to_come[0, read], score + to_come[1, read])
            if not left.all():
                bitmap[rows[~left]] = False
                rows, score = np.flatnonzero(bitmap), score[left]
        return rows, score


def _kth(values: np.ndarray, k: int) -> int | None:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def positives_of(block: Block, anchor: int, label: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the block's ``k`` best rows of the anchor's label."""
    rows = np.arange(*np.searchsorted(block.labels, [label, label + 1]))
    rows = rows[block.ids[rows] != anchor]

    def keep(lower, upper):
        floor = _kth(lower, k)
        return np.ones(len(upper), bool) if floor is None else upper >= floor

    rows, score = block.scan(q, rows, keep)
    best = _best(block.ids[rows], score, k)
    return block.ids[rows[best]], score[best]


def negatives_of(block: Block, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores), for each window of scores, of the block's ``k`` best rows of other labels in it."""
    own = np.searchsorted(block.labels, [label, label + 1])
    rows = np.concatenate([np.arange(own[0]), np.arange(own[1], len(block.ids))])
    open_ = [(lo, hi) for lo, hi in windows if lo <= hi]

    def keep(lower, upper):
        left = np.zeros(len(upper), bool)
        for lo, hi in open_:
            inside = lower[(lower >= lo) & (upper <= hi)]
            floor = _kth(inside, k)
            left |= (upper >= (lo if floor is None else max(lo, floor))) & (lower <= hi)
        return left

    rows, score = block.scan(q, rows, keep) if open_ else (rows[:0], np.zeros(0, np.int64))
    ids, out = block.ids[rows], []
    for lo, hi in windows:
        fit = np.flatnonzero((score >= lo) & (score <= hi))
        best = fit[_best(ids[fit], score[fit], k)]
        out.append((ids[best], score[best]))
    return out


def _blocks(table: pa.Table):
    for r in table.to_pylist():
        yield Block(r["ids"], r["labels"], r["columns"], r["small"])


def _columns(parts: list[tuple], names: list[str]) -> pa.Table:
    """Concatenated columns of (scalar or array, …) parts."""
    size = [max((len(x) for x in p if isinstance(x, np.ndarray)), default=1) for p in parts]
    return pa.table({n: np.concatenate([np.broadcast_to(np.asarray(p[i], np.int64), s) for p, s in zip(parts, size, strict=True)]) if parts else np.zeros(0, np.int64)
                     for i, n in enumerate(names)})


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
         id_col: str = "vec_id", label: str = "label", vector: str = "vector") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` and ``anchors`` carry ``id_col``, a whole-number ``label`` and integer arrays
    ``vector``; scores are inner products, ties go to the smaller id. Positives are an anchor's
    ``n_positives`` best rows of its label, negatives of a positive the ``n_negatives`` best rows
    of other labels with ``low * positive <= 100 * negative <= high * positive``.
    """
    cols = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<long>").alias("v")]
    cand = rows.select(*cols).filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    asked = anchors.select(*cols).filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")
    n_blocks, n_groups = max(1, -(-cand.count() // BLOCK_ROWS)), max(1, -(-asked.count() // ANCHOR_ROWS))
    dealt = cand.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    store = materialise(dealt.groupBy("block").applyInArrow(_store_block, "block int, ids binary, labels binary, small boolean, columns binary"), "vertical")
    per_group = store.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).groupBy("group", "block")

    def per_block(df: DataFrame):
        return (df.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(n_groups)).cast("int"))
                .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).groupBy("group", "block"))

    def find_positives(blocks: pa.Table, group: pa.Table) -> pa.Table:
        q, out = _matrix(group["v"]), []
        for b in _blocks(blocks):
            for i, (anchor, own) in enumerate(zip(group["id"].to_pylist(), group["label"].to_pylist(), strict=True)):
                out.append((anchor, *positives_of(b, anchor, own, q[i], n_positives)))
        return _columns(out, ["anchor_id", "positive_id", "positive_score"])

    found = per_group.cogroup(per_block(asked)).applyInArrow(find_positives, "anchor_id long, positive_id long, positive_score long")
    w = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    best = (found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n_positives)
            .groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")))
    with_windows = asked.join(best.withColumnRenamed("anchor_id", "id"), "id")

    def find_negatives(blocks: pa.Table, group: pa.Table) -> pa.Table:
        q, out = _matrix(group["v"]), []
        positives = group["positives"].to_pylist()
        for b in _blocks(blocks):
            for i, (anchor, own) in enumerate(zip(group["id"].to_pylist(), group["label"].to_pylist(), strict=True)):
                windows = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in positives[i]]
                for p, (ids, score) in zip(positives[i], negatives_of(b, own, q[i], windows, n_negatives), strict=True):
                    out.append((anchor, p["positive_id"], p["positive_score"], ids, score))
        return _columns(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    hard = per_group.cogroup(per_block(with_windows)).applyInArrow(
        find_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return (hard.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_negatives)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
