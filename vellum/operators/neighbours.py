"""Exact neighbour searches and cluster distances that do not compare all with all.

``within``: points are dealt to the cells of sampled pivots. By the triangle inequality a point
can only be near points of cells whose pivot is at most twice the radius farther away than its
own, so it is copied to those cells and compared inside them. ``cluster_means``: the mean
distance to a cluster is at least the distance to its centroid, so clusters whose centroid is
farther than the best mean so far need no comparison.

Cells and clusters of any size are cut into blocks, and a task compares two blocks in strips; it
emits one row per point, never a row per pair. A point is sent once per block that it meets, so
blocks grow with the input up to ``BLOCK_BYTES``: the copies sent stay a fixed multiple of it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import rows as R

BLOCK_ROWS = 1024        # rows of a block, at least
BLOCK_BYTES = 1 << 24    # numbers of a block in a task, at most
CELL_BLOCKS = 16         # cells of all points, and blocks of a cluster, until blocks are that large
CLUSTER_BLOCKS = 8
STRIP_CELLS = 1 << 20    # distances computed at once
MAX_PIVOTS = 1024


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equally long rows as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.clip(d2, 0.0, None))


def strips(a: np.ndarray, b: np.ndarray):
    """Distances of ``a``'s rows to ``b``'s in strips of bounded size: (first row, matrix)."""
    step = max(1, STRIP_CELLS // max(1, len(b)))
    for lo in range(0, len(a), step):
        yield lo, distances(a[lo:lo + step], b)


def most_rows(width: int) -> int:
    """Rows of ``width`` numbers that fill a block."""
    return max(1, BLOCK_BYTES // (8 * max(1, width)))


def cell_rows(points: DataFrame, least: int) -> int:
    """Rows of a cell's blocks for ``id, v, ...``: ``least``, more for larger tables."""
    n, width = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    return max(least, min(most_rows(width or 1), -(-n // CELL_BLOCKS)))


def points_of(df: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    """``id, v`` and further columns; rows without a vector are left out."""
    from pyspark.ml.functions import vector_to_array
    kind = dict(df.dtypes)[vec_col]
    v = F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>") if kind.startswith("array") else vector_to_array(vec_col)
    return df.select(F.col(id_col).alias("id"), v.alias("v"), *more).filter("v IS NOT NULL")


def distinct_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id, v, copies``: one row per distinct vector, its smallest id; ``id, rep``: whose copy each row is)."""
    reps, _ = R.store(points.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "v", "copies"), "points")
    return reps, points.join(reps.select("v", F.col("id").alias("rep")), "v").select("id", "rep")


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities: both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


class Cells:
    """Points dealt to pivots' cells for comparisons within ``eps``."""

    def __init__(self, points: DataFrame, eps: float, seed: int = 42, block_rows: int = BLOCK_ROWS):
        n = points.count()
        most = min(MAX_PIVOTS, max(1, n // block_rows))
        chosen = points.select("id", "v").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).collect()
        pivots = np.array([r["v"] for r in chosen], float)

        def deal(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = distances(matrix(batch.column("v")), pivots)
                home = d.argmin(axis=1)
                own = d[np.arange(len(d)), home]
                row, cell = np.nonzero(d <= own[:, None] + 2 * eps + 1e-9 * (1 + own[:, None]))
                bounds = np.searchsorted(row, np.arange(len(d) + 1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("copies"), pa.array(home, pa.int32()),
                                                  pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(cell, pa.int32()))], names=["id", "v", "copies", "home", "cells"])

        kind = dict(points.dtypes)["id"]
        self.kind = kind
        dealt = points.select("id", "v", "copies").mapInArrow(deal, f"id {kind}, v {dict(points.dtypes)['v']}, copies long, home int, cells array<int>")
        self.table, self.path = R.store(dealt, "cells")
        # One row per pivot: how many rows live in its cell, and how many are compared there.
        here = {r["home"]: r["count"] for r in self.table.groupBy("home").count().collect()}
        seen = {r["cell"]: r["count"] for r in self.table.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}
        blocks = lambda n: max(1, -(-n // block_rows))
        self.home_blocks = F.array(*[F.lit(blocks(here.get(i, 0))) for i in range(max(1, len(chosen)))])
        self.seen_blocks = F.array(*[F.lit(blocks(seen.get(i, 0))) for i in range(max(1, len(chosen)))])
        self.compared = sum(here.get(i, 0) * seen.get(i, 0) for i in range(len(chosen)))

    def compare(self, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, table: DataFrame | None = None) -> DataFrame:
        """``run(residents, visitors)`` for every pair of blocks of a cell; every point meets all points near it where it lives."""
        table = self.table if table is None else table

        def block(blocks: Column, cell: Column) -> Column:
            return F.pmod(F.xxhash64("id"), F.element_at(blocks, cell + 1)).cast("int")

        def all_of(blocks: Column, cell: Column) -> Column:
            return F.explode(F.sequence(F.lit(0), F.element_at(blocks, cell + 1) - 1))

        home = table.withColumn("cell", F.col("home")).withColumn("a", block(self.home_blocks, F.col("cell"))).withColumn("b", all_of(self.seen_blocks, F.col("cell")))
        guests = table.withColumn("cell", F.explode("cells")).withColumn("b", block(self.seen_blocks, F.col("cell"))).withColumn("a", all_of(self.home_blocks, F.col("cell")))
        drop = ["home", "cells"]
        return home.drop(*drop).groupBy("cell", "a", "b").cogroup(_fresh(guests.drop(*drop)).groupBy("cell", "a", "b")).applyInArrow(run, schema)


def itself(a: pa.Table, b: pa.Table) -> np.ndarray:
    """The row of ``b`` that holds each row of ``a`` (by id), -1 where none does."""
    at = pa.compute.index_in(a["id"].combine_chunks(), b["id"].combine_chunks())
    return at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def tie(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each node's smallest tied node) once ``a`` and ``b`` are tied too."""
    a, b = label[a], label[b]
    new = np.unique(a[a != b] * len(label) + b[a != b])
    a, b = new // len(label), new % len(label)
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return label


def core_distances(cells: Cells, eps: float, others: int) -> DataFrame:
    """``id, core``: the distance within which each point has ``others`` other points (copies count); only where that is at most ``eps``."""
    kind = cells.kind
    if others <= 0:
        return cells.table.select("id", F.lit(0.0).alias("core"))

    def nearest(home: pa.Table, guests: pa.Table) -> pa.Table:
        if not home.num_rows or not guests.num_rows:
            return pa.table({"id": home["id"][:0], "d": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        same = itself(home, guests)
        k = min(others, guests.num_rows)
        found = []
        for lo, d in strips(matrix(home["v"]), matrix(guests["v"])):
            at = np.flatnonzero(same[lo:lo + len(d)] >= 0)
            d[at, same[lo + at]] = np.inf
            col = np.argpartition(d, k - 1, axis=1)[:, :k]
            row = np.repeat(np.arange(len(d)), k)
            far, col = d[row, col.ravel()], col.ravel()
            keep = far <= eps
            found.append((lo + row[keep], far[keep], col[keep]))
        row, far, col = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"id": home["id"].take(pa.array(row)), "d": pa.array(far), "n": guests["copies"].take(pa.array(col))})

    found = cells.compare(nearest, f"id {kind}, d double, n long")
    own = cells.table.select("id", F.lit(0.0).alias("d"), (F.col("copies") - 1).alias("n")).filter("n > 0")
    so_far = F.sum("n").over(Window.partitionBy("id").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return found.unionByName(own).withColumn("m", so_far).filter(F.col("m") >= others).groupBy("id").agg(F.min("d").alias("core"))


def links(cells: Cells, core: DataFrame, eps: float) -> DataFrame:
    """``i, j``: enough pairs to connect all points whose mutual reachability is at most ``eps``, about one per point and block."""
    kind = cells.kind

    def connect(home: pa.Table, guests: pa.Table) -> pa.Table:
        none = pa.table({"i": home["id"][:0], "j": home["id"][:0]})
        if not home.num_rows or not guests.num_rows:
            return none
        ids = pa.concat_arrays([home["id"].combine_chunks(), guests["id"].combine_chunks()])
        coded = ids.dictionary_encode()
        node = np.asarray(coded.indices).astype(np.int64)
        label = np.arange(len(coded.dictionary))
        mine, theirs = home["core"].to_numpy(), guests["core"].to_numpy()
        for lo, d in strips(matrix(home["v"]), matrix(guests["v"])):
            a, b = np.nonzero(d <= eps)
            a = a + lo
            near = np.maximum(mine[a], theirs[b]) <= eps
            label = tie(label, node[a[near]], node[len(home) + b[near]])
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"i": coded.dictionary.take(pa.array(tied)), "j": coded.dictionary.take(pa.array(label[tied]))}) if len(tied) else none

    table = cells.table.join(core, "id")
    found = cells.compare(connect, f"i {kind}, j {kind}", table).distinct()
    return found.unionByName(found.select(F.col("j").alias("i"), F.col("i").alias("j")))


def cluster_sums(asks: DataFrame, points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id, grp, dsum, n``: summed distance of each asking point (``id, v, grp``) to the other points of a cluster, and their number."""
    kind = dict(points.dtypes)["id"]
    width = points.agg(F.max(F.size("v"))).first()[0] or 1
    rows = F.greatest(F.lit(block_rows), F.least(F.lit(most_rows(width)), F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCKS)))
    size = lambda df, name: df.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    sizes, _ = R.store(size(asks, "na").join(size(points, "nb"), "grp"), "cluster-blocks")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(sizes, "grp").withColumn("a", block("na")).withColumn("b", every("nb")).drop("na", "nb")
    right = points.join(sizes, "grp").withColumn("b", block("nb")).withColumn("a", every("na")).drop("na", "nb")

    def sums(asking: pa.Table, members: pa.Table) -> pa.Table:
        if not asking.num_rows or not members.num_rows:
            return pa.table({"id": asking["id"][:0], "grp": asking["grp"][:0], "dsum": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        same, total = itself(asking, members), np.zeros(asking.num_rows)
        for lo, d in strips(matrix(asking["v"]), matrix(members["v"])):
            at = np.flatnonzero(same[lo:lo + len(d)] >= 0)
            d[at, same[lo + at]] = 0.0
            total[lo:lo + len(d)] = d.sum(axis=1)
        n = members.num_rows - (same >= 0)
        return pa.table({"id": asking["id"], "grp": asking["grp"], "dsum": pa.array(total), "n": pa.array(n)})

    parts = left.groupBy("grp", "a", "b").cogroup(_fresh(right).groupBy("grp", "a", "b")).applyInArrow(sums, f"id {kind}, grp long, dsum double, n long")
    return parts.groupBy("id", "grp").agg(F.sum("dsum").alias("dsum"), F.sum("n").alias("n"))


def silhouettes(points: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, float]:
    """(``id, s``: each point's Euclidean silhouette, share of the point pairs that were compared).

    ``points``: ``id, v, grp``. A point's own cluster and the one of the nearest other centroid
    are compared first; of the rest only those whose centroid is nearer than that mean.
    """
    table, _ = R.store(points.filter("grp IS NOT NULL"), "silhouette-points")
    width = table.agg(F.max(F.size("v"))).first()[0] or 0
    mean = table.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("v")[j]) for j in range(width)]).alias("c"))
    groups = mean.orderBy("grp").collect()  # one row per cluster
    names, sizes = np.array([r["grp"] for r in groups], np.int64), {r["grp"]: r["n"] for r in groups}
    centres = np.array([r["c"] for r in groups], float).reshape(len(groups), width)
    kind, vectors = dict(table.dtypes)["id"], dict(table.dtypes)["v"]
    n = sum(sizes.values())

    def first(batches):
        for batch in batches:
            d = distances(matrix(batch.column("v")), centres)
            own = np.searchsorted(names, batch.column("grp").to_numpy())
            d[np.arange(len(d)), own] = np.inf
            near = np.where(np.isfinite(d.min(axis=1)), names[d.argmin(axis=1)], -1) if len(names) > 1 else np.full(len(d), -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("grp"), pa.array(near.astype(np.int64))], names=["id", "v", "grp", "near"])

    asked, _ = R.store(table.select("id", "v", F.col("grp").cast("long").alias("grp")).mapInArrow(first, f"id {kind}, v {vectors}, grp long, near long"), "silhouette-asks")
    members = asked.select("id", "v", "grp")
    nearest = asked.filter(F.lit(len(names) > 1)).select("id", "v", F.col("near").alias("grp"))
    own_and_near, _ = R.store(cluster_sums(members.unionByName(nearest), members, block_rows), "silhouette-first")
    best = own_and_near.join(asked.select("id", "near"), "id").filter("grp = near").select("id", (F.col("dsum") / F.col("n")).alias("best"))

    def rest(batches):
        for batch in batches:
            d = distances(matrix(batch.column("v")), centres)
            row, col = np.nonzero(d < batch.column("best").to_numpy()[:, None])
            grp = names[col]
            keep = (grp != batch.column("grp").to_numpy()[row]) & (grp != batch.column("near").to_numpy()[row])
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("v").take(take), pa.array(grp[keep])], names=["id", "v", "grp"])

    more, _ = R.store(asked.join(best, "id").select("id", "v", "grp", "near", "best").mapInArrow(rest, f"id {kind}, v {vectors}, grp long"), "silhouette-rest")
    sums = own_and_near.unionByName(cluster_sums(more, members, block_rows)) if not more.isEmpty() else own_and_near
    compared = sums.agg(F.sum("n")).first()[0] or 0
    per = sums.join(asked.select("id", F.col("grp").alias("own")), "id").groupBy("id").agg(
        F.max(F.when(F.col("grp") == F.col("own"), F.col("dsum") / F.nullif(F.col("n"), F.lit(0)))).alias("a"),
        F.min(F.when(F.col("grp") != F.col("own"), F.col("dsum") / F.col("n"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.select("id", s.alias("s")), compared / max(1, n * (n - 1))
