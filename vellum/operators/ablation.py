"""Ablation curves: rescoring the test set with parts of the model removed.

Every curve is ONE job over the test features, read once: retained fractions are nested,
so each weight is summed once at the smallest fraction that keeps it; removed classes and
features are subtracted from the cached logits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import evaluate as EV
from vellum.operators import packed as P
from vellum.operators import scoring as SC
from vellum.operators.common import checked_broadcast


def _nested_curve(features: DataFrame, labels: DataFrame, wide: DataFrame, fractions: list[float], bias: list[float],
                  n_classes: int, term_col: str) -> DataFrame:
    """F1 per retained fraction, in one pass over the features without expanding them.

    The kept sets are nested, so a weight belongs to the smallest fraction that keeps it.
    ``wide`` has per term and class the weight ``w_k`` and the place ``j_k`` of that fraction in
    ``fractions`` (ascending; null: none keeps it). A document sums its contributions per
    place once; the logits of a fraction are the running sums up to its place.
    """
    m = len(fractions)
    cells = [(j, k) for j in range(m) for k in range(n_classes)]
    table = P.small_table(wide) if P.is_packed(features, term_col) else None
    if table is not None:
        part = features.select("doc_id", P.placed_sums(table, n_classes, m, term_col).alias("_s")).select(
            "doc_id", *[F.col("_s")[i].alias(f"s_{j}_{k}") for i, (j, k) in enumerate(cells)])
    else:
        rows = P.unpack(features, (term_col, "x")) if P.is_packed(features, term_col) else features
        joined = rows.join(checked_broadcast(wide), term_col)
        part = joined.select("doc_id", *[F.when(F.col(f"j_{k}") == j, F.col("x") * F.col(f"w_{k}")).otherwise(0.0).alias(f"s_{j}_{k}") for j, k in cells])
    zeros = labels.select("doc_id", *[F.lit(0.0).alias(f"s_{j}_{k}") for j, k in cells])
    sums = part.unionByName(zeros).groupBy("doc_id").agg(*[F.sum(f"s_{j}_{k}").alias(f"s_{j}_{k}") for j, k in cells])
    running: list[list] = []
    for j in range(m):
        running.append([F.col(f"s_{j}_{k}") + (running[-1][k] if running else F.lit(bias[k])) for k in range(n_classes)])
    preds = [F.struct(F.lit(f).alias("fraction"), SC.argmax(F.array(*z)).alias("pred")) for f, z in zip(fractions, running, strict=True)]
    pairs = (sums.join(labels, "doc_id").select("label", F.explode(F.array(*preds)).alias("e"))
                 .select("label", "e.fraction", "e.pred"))
    return EV.weighted_f1(pairs, ["fraction"])


def _place(rank, keeps: list[int]):
    """Place of the smallest kept count above ``rank``; null if there is none."""
    return F.coalesce(F.lit(None).cast("int"), *[F.when(rank < n, F.lit(j)) for j, n in enumerate(keeps)])


def _kept(step, n: int) -> tuple[list[float], list[int]]:
    fractions = sorted(EV.retention_schedule(step))
    return fractions, [max(1, int(math.floor(f * n))) for f in fractions]


def f1_retention_curve(features: DataFrame, labels: DataFrame, weights: DataFrame, bias: DataFrame,
                       ranked: DataFrame, n_classes: int, step=0.1, chosen: float = 0.5,
                       term_col: str = "term") -> DataFrame:
    """Weighted F1 after keeping only the lowest-variance fraction of the classifier
    weights, for every fraction of the schedule (``ranked`` = weights' ``(class_no,
    term, rank)`` by ascending variance). ``is_chosen`` marks the fraction nearest ``chosen``."""
    fractions, keeps = _kept(step, ranked.count())
    placed = weights.join(ranked.select("class_no", term_col, "rank"), ["class_no", term_col]).withColumn("j", _place(F.col("rank"), keeps))
    wide = placed.groupBy(term_col).agg(*[F.max(F.when(F.col("class_no") == k, F.col(c))).alias(f"{c}_{k}") for k in range(n_classes) for c in ("w", "j")])
    curve = _nested_curve(features, labels, wide, fractions, SC.bias_list(bias, n_classes), n_classes, term_col)
    near = min(reversed(fractions), key=lambda f: abs(f - chosen))
    return curve.withColumn("is_chosen", F.col("fraction") == F.lit(near))


def f1_vocabulary_retention(features: DataFrame, labels: DataFrame, weights: DataFrame, bias: DataFrame,
                            term_rank: DataFrame, n_classes: int, step=0.1, term_col: str = "term") -> DataFrame:
    """As :func:`f1_retention_curve`, keeping whole vocabulary entries ranked by their
    mean variance over classes (``term_rank`` = ``(term, rank)``)."""
    fractions, keeps = _kept(step, term_rank.count())
    wide = SC.wide_weights(weights, n_classes, term_col=term_col).join(term_rank, term_col)
    wide = wide.select(term_col, *[f"w_{k}" for k in range(n_classes)], *[_place(F.col("rank"), keeps).alias(f"j_{k}") for k in range(n_classes)])
    return _nested_curve(features, labels, wide, fractions, SC.bias_list(bias, n_classes), n_classes, term_col)


def f1_bias_removal(scored: DataFrame, labels: DataFrame, bias: DataFrame, n_classes: int) -> DataFrame:
    """Weighted F1 after zeroing each class bias in turn (``removed_class``)."""
    b = SC.bias_list(bias, n_classes)
    barr = F.array(*[F.lit(x) for x in b])
    rows = scored.join(labels, "doc_id").select(
        "label", "logits", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("removed_class"))
    new = F.transform("logits", lambda z, k: z - F.when(k == F.col("removed_class"), barr[k]).otherwise(0.0))
    pairs = rows.select(F.col("removed_class").cast("int").alias("removed_class"), "label", SC.argmax(new).alias("pred"))
    return EV.weighted_f1(pairs, ["removed_class"])


def f1_feature_removal(features: DataFrame, scored: DataFrame, labels: DataFrame, weights: DataFrame,
                       terms: list[str], n_classes: int, term_col: str = "term") -> DataFrame:
    """Weighted F1 after removing each listed feature in turn: its contribution
    ``x·w`` is subtracted from the cached logits of the documents that contain it.
    Rows are (removed feature × test document): bounded by len(terms) × documents."""
    wide = SC.wide_weights(weights.filter(F.col(term_col).isin(terms)), n_classes, term_col=term_col)
    contrib = (features.filter(F.col(term_col).isin(terms)).join(checked_broadcast(wide), term_col)
                       .select("doc_id", F.col(term_col).alias("removed"),
                               F.array(*[F.col("x") * F.col(f"w_{k}") for k in range(n_classes)]).alias("c")))
    base = scored.join(labels, "doc_id").select("doc_id", "label", "logits",
                                                F.explode(F.array(*[F.lit(t) for t in terms])).alias("removed"))
    j = base.join(contrib, ["doc_id", "removed"], "left")
    new = F.when(F.col("c").isNull(), F.col("logits")).otherwise(F.zip_with("logits", "c", lambda z, c: z - c))
    pairs = j.select("removed", "label", SC.argmax(new).alias("pred"))
    return EV.weighted_f1(pairs, ["removed"])
