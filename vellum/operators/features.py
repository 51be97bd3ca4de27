"""Vocabulary, bag of words, count vectoriser bounds, TF-IDF, document embeddings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import packed as P
from vellum.operators.common import reuse
from vellum.operators.ranking import global_index


def build_vocabulary(counts: DataFrame, doc_col: str = "doc_id", term_col: str = "term",
                     n_col: str = "n") -> DataFrame:
    """Distinct terms with a dense id (term order), corpus and document frequency.

    ``counts`` is ``(doc, term, n)`` with one row per (doc, term), so the document
    frequency is a plain row count and both aggregates combine map-side.
    """
    vocab = counts.groupBy(term_col).agg(F.sum(n_col).cast("long").alias("cf"),
                                         F.count(F.lit(1)).alias("df"))
    return global_index(vocab, [F.col(term_col)], name="token_id")


def bag_of_words(counts: DataFrame, vocab: DataFrame, doc_col: str = "doc_id",
                 term_col: str = "term", n_col: str = "n") -> DataFrame:
    """``(doc, token_id, n)``. The vocabulary side has one row per term, so a hot term
    only skews the token side, which AQE's skew-join split handles."""
    return (counts.join(vocab.select(term_col, "token_id"), term_col)
                  .select(doc_col, "token_id", F.col(n_col).alias("n")))


def _bound(value, n_docs: int, is_max: bool) -> float:
    if value is None:
        return math.inf if is_max else -math.inf
    if isinstance(value, float):
        return value * n_docs
    return float(value)


def count_vectorise(counts: DataFrame, doc_col: str = "doc_id", term_col: str = "term",
                    n_col: str = "n", min_df=1, max_df=1.0, max_features: int | None = None,
                    n_docs: int | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Terms kept by a count vectoriser: ``min_df ≤ df ≤ max_df`` (ints are absolute,
    floats are shares of the documents), then the ``max_features`` most frequent terms
    (ties by term). Returns ``(term, df, cf)``; semi-join it onto ``counts`` to filter.
    ``stats``: the terms' frequencies ``(term, df, cf)``, if they are counted already."""
    if stats is None:
        stats = counts.groupBy(term_col).agg(F.count(F.lit(1)).alias("df"),
                                             F.sum(n_col).cast("long").alias("cf"))
    if n_docs is None:
        n_docs = counts.select(F.countDistinct(doc_col)).first()[0] or 0
    lo, hi = _bound(min_df, n_docs, False), _bound(max_df, n_docs, True)
    kept = stats
    if lo > -math.inf:
        kept = kept.filter(F.col("df") >= F.lit(lo))
    if hi < math.inf:
        kept = kept.filter(F.col("df") <= F.lit(hi))
    if max_features:
        # Global top-k: each partition keeps k rows, the merge sees partitions × k.
        kept = kept.orderBy(F.desc("cf"), F.asc(term_col)).limit(int(max_features))
    return kept


def restrict_terms(counts: DataFrame, kept: DataFrame, term_col: str = "term") -> DataFrame:
    """Semi-join ``counts`` onto the kept terms (bounded by ``max_features`` when set)."""
    return counts.join(kept.select(term_col), term_col, "left_semi")


def tfidf(counts: DataFrame, doc_col: str = "doc_id", term_col: str = "term", n_col: str = "n",
          min_df=0.02, max_df=0.57, n_docs: int | None = None, vocab: pa.Array | None = None) -> DataFrame:
    """Smoothed TF-IDF, L2-normalised per document, in long form ``(doc, term, tf, idf, w)``.

    ``idf = ln((1+N)/(1+df)) + 1`` (MLlib's ``IDF`` has no ``+1``, so it is written out).
    The idf table is the kept vocabulary (broadcast when AQE measures it small). With ``vocab``, ``counts``
    are packed places in it, of every term that the bounds may keep (:func:`tokens.shared_counts`).
    """
    if vocab is not None:
        return _packed_tfidf(counts, doc_col, min_df, max_df, n_docs, vocab)
    counts = reuse(counts)      # read by the df statistics, the weights and the norms
    if n_docs is None:
        n_docs = counts.select(F.countDistinct(doc_col)).first()[0] or 0
    kept = count_vectorise(counts, doc_col, term_col, n_col, min_df, max_df, None, n_docs)
    idf = kept.select(term_col, (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    raw = (counts.join(idf, term_col)
                 .select(doc_col, term_col, F.col(n_col).alias("tf"), "idf",
                         (F.col(n_col) * F.col("idf")).alias("raw")))
    # One document's kept terms per window group (bounded by the document, no hot key);
    # when the counts are already partitioned by document this needs no shuffle at all.
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc_col)))
    return raw.select(doc_col, term_col, "tf", "idf", (F.col("raw") / norm).alias("w"))


def _packed_tfidf(counts: DataFrame, doc_col: str, min_df, max_df, n_docs: int, vocab: pa.Array) -> DataFrame:
    """:func:`tfidf` of packed places: a document's terms stay in its row until its weights are known."""
    kept = count_vectorise(counts, doc_col, min_df=min_df, max_df=max_df, n_docs=n_docs, stats=P.place_frequencies(counts, len(vocab))).toArrow()
    idf = np.full(len(vocab), np.nan)
    idf[kept["term"].to_numpy()] = np.log((1.0 + n_docs) / (1.0 + kept["df"].to_numpy())) + 1.0
    rows = counts.select(doc_col, P.weighted(idf).alias("_w")).select(doc_col, "_w.term", "_w.tf", "_w.idf", "_w.raw").filter(F.size("term") > 0)
    own = F.aggregate("raw", F.lit(0.0), lambda a, v: a + v * v)
    # Rows that repeat a document share its norm.
    rows = rows.withColumn("_norm", F.sqrt(F.sum(own).over(Window.partitionBy(doc_col))))
    rows = rows.select(doc_col, P.named("term", vocab).alias("term"), "tf", "idf", F.transform("raw", lambda v: v / F.col("_norm")).alias("w"))
    return P.unpack(rows, ("term", "tf", "idf", "w"))
