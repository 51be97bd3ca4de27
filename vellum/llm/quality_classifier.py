"""Naive Bayes support vectors: a linear quality classifier over n-gram indicators.

Each text becomes the set of its word 1- and 2-grams and byte 3-grams, hashed to ``BUCKETS``
indicators (a word that repeats the one before it becomes one fixed symbol, so runs of any
word look alike). Indicators are scaled by the log ratio of their smoothed class counts,
rows are brought to unit length, and a linear hinge-loss model is fitted by dual coordinate
descent. The model is a table of at most ``BUCKETS`` weights, small enough to broadcast
whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import textspans as ts

BUCKETS = 1 << 18
#: Labelled documents that the fit uses, about; chosen by hash, so the same at every run.
MAX_TRAIN = 6000
C, EPOCHS, SMOOTHING = 1.0, 12, 1.0
_SAME = np.uint64(0x5851F42D4C957F2D)
_CHUNK = 2 << 20


def features(part: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every distinct indicator, sorted by document."""
    start, end, doc = ts.word_spans(part)
    prefix = ts.prefix_hash(part.data)
    h = ts.span_hash(prefix, start, end)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    h = np.where(same, _SAME, h)
    pairs, p_doc = ts.ngram_hash(h, doc, 2)
    at = np.arange(max(0, len(part.data) - 2))
    b_doc = part.doc_of(at)
    at, b_doc = (x[part.off[b_doc + 1] >= at + 3] for x in (at, b_doc))
    triples = ts.span_hash(prefix, at, at + 3)
    hashes = np.concatenate([h, pairs, triples ^ np.uint64(0x9E3779B97F4A7C15)])
    docs = np.concatenate([doc, p_doc, b_doc])
    key = np.unique(docs * BUCKETS + (ts.mix64(hashes) % np.uint64(BUCKETS)).astype(np.int64))
    return key // BUCKETS, key % BUCKETS


@dataclass
class Model:
    """Weights of the indicators (class log-count ratio times fitted weight), bias and score slope.

    ``prior`` is the score of everything where the labels hold fewer than two classes.
    """

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    prior: float | None = None

    def score(self, n: int, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Probability-like score of label 1 for ``n`` documents."""
        if self.prior is not None:
            return np.full(n, self.prior)
        norm = np.sqrt(np.bincount(doc, weights=self.ratio[bucket] ** 2, minlength=n))
        dot = np.bincount(doc, weights=self.ratio[bucket] * self.weight[bucket], minlength=n)
        margin = dot / np.maximum(norm, 1e-12) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin, -30, 30)))


def fit(sets: list[np.ndarray], label: np.ndarray, c: float = C, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on sets of buckets and 0/1 labels."""
    if not len(label) or label.min() == label.max():
        zero = np.zeros(BUCKETS)
        return Model(zero, zero, 0.0, 1.0, float(label.mean()) if len(label) else 0.5)
    y = np.where(label == 1, 1.0, -1.0)
    counts = [np.bincount(np.concatenate([s for s, v in zip(sets, label, strict=True) if v == k] or [np.zeros(0, np.int64)]), minlength=BUCKETS) + SMOOTHING for k in (1, 0)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    rows = [ratio[s] / max(float(np.sqrt((ratio[s] ** 2).sum())), 1e-12) for s in sets]

    # Dual coordinate descent for the hinge loss; the bias is a constant feature of value 1.
    w, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(y))
    diagonal = np.array([float((x * x).sum()) + 1.0 for x in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            s, x = sets[i], rows[i]
            gradient = y[i] * (float(w[s] @ x) + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[s] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    margin = np.array([float(w[s] @ x) + bias for s, x in zip(sets, rows, strict=True)])
    return Model(ratio, w, bias, _slope(margin, y))


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic link that fits the labels best (one-dimensional Newton steps)."""
    a = 1.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * margin * y, -30, 30)))
        g = float((margin * y * (1 - p)).mean()) - 1e-3 * a
        hess = float((margin ** 2 * p * (1 - p)).mean()) + 1e-3
        a = float(np.clip(a + g / hess, 0.1, 50))
    return a


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Fit on documents with a 0/1 label, at most about ``max_train`` of them, chosen by hash.

    A document with several labels counts with the smallest, a repeated document id with one
    text; null labels and labels without a document are ignored.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    share = min(1.0, max_train / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # Bounded by max_train, so the texts are not shuffled.
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ts.chunks(batch.column(2), _CHUNK):
                doc, bucket = features(part)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(part.n + 1)), pa.int32()), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(part.lo, part.n) for i in (0, 1)], lists], names=["id", "y", "f"])

    rows = (src.select("id", "y", "t").mapInArrow(sets, T.StructType([src.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("f", T.ArrayType(T.IntegerType()))]))
            .groupBy("id").agg(F.min("y").alias("y"), F.min("f").alias("f")))

    def solve(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group["h"].to_numpy(), kind="stable")))
        lists = group["f"].combine_chunks()
        flat, ends = np.asarray(lists.flatten()).astype(np.int64), np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
        m = fit([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], group["y"].to_numpy())
        used = np.flatnonzero(m.ratio)
        return pa.table({"bucket": np.append(used, [-1, -2, -3]), "ratio": np.append(m.ratio[used], [m.bias, m.slope, -1.0 if m.prior is None else m.prior]), "weight": np.append(m.weight[used], [0.0, 0.0, 0.0])})

    model = (rows.withColumn("h", F.xxhash64("id")).withColumn("one", F.lit(0)).groupBy("one")
             .applyInArrow(solve, "bucket long, ratio double, weight double").toArrow())
    if not model.num_rows:
        return fit([], np.zeros(0))
    bucket, ratio, weight = (model[c].to_numpy() for c in ("bucket", "ratio", "weight"))
    r, w = np.zeros(BUCKETS), np.zeros(BUCKETS)
    r[bucket[bucket >= 0]], w[bucket[bucket >= 0]] = ratio[bucket >= 0], weight[bucket >= 0]
    extra = {int(b): float(v) for b, v in zip(bucket, ratio, strict=True) if b < 0}
    return Model(r, w, extra[-1], extra[-2], None if extra[-3] < 0 else extra[-3])


def predict(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col, score, predicted`` for every row of ``docs``: one pass, no shuffle.

    Defined results: a null or empty text has no indicator and is scored by the bias alone;
    repeated rows are scored row by row; a null id is kept; further columns are ignored.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ts.chunks(batch.column(1), _CHUNK):
                score = shared.value.score(part.n, *features(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.n), pa.array(score)], names=["id", "score"])

    out = src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("score", T.DoubleType())]))
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
