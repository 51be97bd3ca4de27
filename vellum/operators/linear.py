"""Linear models fitted by limited-memory quasi-Newton steps over aggregated gradients.

Rows are written once (positions and values of their features, and the target). Each pass adds
up the loss and its gradient over all rows, a matrix of the model's size; the step is taken on
the driver, which holds the model and a few earlier gradients. The loss is the mean
cross-entropy of a softmax, or the mean smooth-L1 of a single output (quadratic up to an error
of 1, linear beyond; no scale is fitted). A fit may start from a stored version's weights.

Defined results: rows without target or features' vector take part as rows without features (a
null target leaves the row out); an empty table gives the starting weights; positions that the
starting model lacks start at 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import rows as R

MEMORY = 10  # earlier steps that shape the direction


@dataclass
class Linear:
    """``weights[position, output]`` with the intercepts in the last row; ``losses`` after each pass."""

    weights: np.ndarray
    kind: str
    losses: list[float] = field(default_factory=list)

    def predict(self, df: DataFrame, features_col: str = "features") -> DataFrame:
        """``df`` with ``prediction`` (and ``probability``, for a classifier)."""
        w, soft = self.weights, self.kind == "softmax"

        @F.arrow_udf("array<double>")
        def outputs(idx: pa.Array, val: pa.Array) -> pa.Array:
            z = _scores(idx, val, w)
            if soft:
                z = _softmax(z)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))

        out = df.withColumn("_out", outputs(*R.parts(features_col, dict(df.dtypes)[features_col])))
        if not soft:
            return out.withColumn("prediction", F.col("_out")[0]).drop("_out")
        return out.withColumn("prediction", (F.array_position("_out", F.array_max("_out")) - 1).cast("double")).withColumnRenamed("_out", "probability")


def _scores(idx: pa.Array, val: pa.Array, w: np.ndarray) -> np.ndarray:
    size = np.asarray(idx.value_lengths())
    row = np.repeat(np.arange(len(size)), size)
    pos, x = idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False)
    row, pos, x = (v[pos < len(w) - 1] for v in (row, pos, x))
    return np.stack([np.bincount(row, weights=x * w[pos, k], minlength=len(size)) + w[-1, k] for k in range(w.shape[1])], axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cross_entropy(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """(summed loss, its derivative by the outputs)."""
    p, at = _softmax(z), np.arange(len(y))
    loss = -np.log(np.maximum(p[at, y.astype(int)], 1e-300)).sum()
    p[at, y.astype(int)] -= 1
    return float(loss), p


def smooth_l1(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    r = z[:, 0] - y
    far = np.abs(r) >= 1
    return float(np.where(far, np.abs(r) - 0.5, r * r / 2).sum()), np.where(far, np.sign(r), r)[:, None]


LOSSES = {"softmax": cross_entropy, "smooth_l1": smooth_l1}


def _pass(w: np.ndarray, loss: Callable) -> Callable:
    """Gradient sums of a task's rows; a last row holds the loss."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(w) + 1, w.shape[1]))
        for batch in batches:
            row, pos, val = R.csr(batch)
            value, g = loss(_scores(batch.column(1), batch.column(2), w), batch.column(3).to_numpy())
            total[-1, 0] += value
            total[-2] += g.sum(axis=0)
            for k in range(w.shape[1]):
                total[:-2, k] += np.bincount(pos, weights=val * g[row, k], minlength=len(w) - 1)
        yield R.emit(total)
    return run


def minimise(at: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, max_passes: int, tol: float) -> tuple[np.ndarray, list[float]]:
    """(weights, loss after each accepted step) of a limited-memory quasi-Newton descent with step halving."""
    value, g = at(w)
    losses, steps = [value], []
    passes = 1
    while passes < max_passes and np.abs(g).max() > tol:
        # Two-loop recursion over the remembered (step, change of gradient) pairs.
        q, used = g.copy(), []
        for s, y in reversed(steps):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            used.append(a)
        if steps:
            s, y = steps[-1]
            q *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(steps, reversed(used), strict=True):
            q += s * (a - (y * q).sum() / (s * y).sum())
        size, slope = (1.0 if steps else 1.0 / max(1.0, np.abs(g).sum())), -(q * g).sum()
        while True:
            new = w - size * q
            found, new_g = at(new)
            passes += 1
            if found <= value + 1e-4 * size * slope or passes >= max_passes:
                break
            size /= 2
        if found > value:
            break
        s, y = new - w, new_g - g
        if (s * y).sum() > 1e-12 * (y * y).sum():
            steps = [*steps, (s, y)][-MEMORY:]
        w, value, g = new, found, new_g
        losses.append(value)
    return w, losses


def fit(df: DataFrame, kind: str, features_col: str, label_col: str, outputs: int | None = None, init: np.ndarray | None = None,
        reg: float = 0.0, max_passes: int = 60, tol: float = 1e-5) -> Linear:
    """A model of ``kind`` (``softmax``: labels 0, 1, …; ``smooth_l1``: one number) with weights penalised by ``reg / 2`` times their squares."""
    idx, val = R.parts(features_col, dict(df.dtypes)[features_col])
    src = df.select(F.lit(None).cast("long").alias("id"), idx.alias("idx"), val.alias("val"), F.col(label_col).cast("double").alias("y")).filter("y IS NOT NULL")
    table, path = R.store(src, "labelled")
    n, width, top = table.agg(F.count(F.lit(1)), F.max(F.array_max("idx")), F.max("y")).first()
    k = 1 if kind == "smooth_l1" else max(outputs or 0, int(top or 0) + 1, init.shape[1] if init is not None else 2)
    w = np.zeros((max((width if width is not None else -1) + 1, len(init) - 1 if init is not None else 0) + 1, k))
    if init is not None:
        w[:len(init) - 1, :init.shape[1]], w[-1, :init.shape[1]] = init[:-1], init[-1]
    if not n:
        return Linear(w, kind)

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        total = R.collect_sum(table.mapInArrow(_pass(w, LOSSES[kind]), R.SUMS), (len(w) + 1, w.shape[1])) / n
        pull = np.vstack([w[:-1], np.zeros((1, w.shape[1]))])
        return float(total[-1, 0] + reg / 2 * (pull * pull).sum()), total[:-1] + reg * pull

    w, losses = minimise(at, w, max_passes, tol)
    R.drop(table.sparkSession, path)
    return Linear(w, kind, losses)


def save(model: Linear, spark: SparkSession, base_path: str, version: str) -> str:
    """Store a model's weights under ``version=…``: ``kind, position, output, w`` (position -1 for the intercepts)."""
    rows = [(model.kind, p if p < len(model.weights) - 1 else -1, k, float(x)) for p, row in enumerate(model.weights) for k, x in enumerate(row)]
    (spark.createDataFrame(rows, "kind string, position int, output int, w double").withColumn("version", F.lit(version))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(base_path))
    return base_path


def load(spark: SparkSession, base_path: str, version: str) -> Linear | None:
    """A stored version; None if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base_path}/version={version}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.parquet(path.toString()).collect()  # the model's size
    w = np.zeros((max(r["position"] for r in rows) + 2, max(r["output"] for r in rows) + 1))
    for r in rows:
        w[r["position"], r["output"]] = r["w"]
    return Linear(w, rows[0]["kind"])
