"""Linear text scorer as data: features, weights, softmax, chunk averaging, uncertainty.

Model tables:
  features ``(doc_id, term, x)`` with ``x = tf / doc_length`` over the vocabulary,
  weights  ``(class_no, term, w)`` and bias ``(class_no, b)``,
  variance ``(param, class_no, term, variance)`` with ``param`` in {weight, bias}.

Scoring joins features to the weights and sums per document. The weight table holds the
whole vocabulary; it is broadcast if its row count is below a limit and joined by a
shuffle on the term beyond it. Per-document results
are formed in one ``groupBy(doc_id)`` with one sum per class (map-side partial
aggregation), and the softmax is array arithmetic inside that row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import packed as P
from vellum.operators.common import checked_broadcast, reuse


# ---------------------------------------------------------------- weights
def closed_form_weights(class_counts: DataFrame, class_docs: DataFrame, vocab: DataFrame,
                        n_classes: int, term_col: str = "term"):
    """Smoothed class log-likelihood weights and log-prior biases.

    ``w(c,t) = ln((n(c,t)+1) / (n(c)+|V|))``, ``b(c) = ln(docs(c)/docs)``.
    ``class_counts`` is ``(class_no, term, n)`` over training documents restricted to the
    vocabulary, ``class_docs`` is ``(class_no, docs)``. The (class × term) grid is the
    vocabulary exploded by the class list: bounded by K × |V|.
    """
    v_size = vocab.count()
    grid = vocab.select(term_col, F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("class_no"))
    nc = class_counts.groupBy("class_no").agg(F.sum("n").alias("nc"))
    w = (grid.join(class_counts, ["class_no", term_col], "left")
             .join(nc, "class_no", "left")
             .select("class_no", term_col,
                     F.log((F.coalesce(F.col("n"), F.lit(0)) + 1.0) /
                           (F.coalesce(F.col("nc"), F.lit(0)) + F.lit(float(v_size)))).alias("w")))
    total = class_docs.agg(F.sum("docs")).first()[0]
    b = class_docs.select("class_no", F.log(F.col("docs") / F.lit(float(total))).alias("b"))
    return w, b


def bias_list(bias: DataFrame, n_classes: int) -> list[float]:
    """Bias vector on the driver: one number per class."""
    got = {int(r["class_no"]): float(r["b"]) for r in bias.collect()}
    return [got.get(k, 0.0) for k in range(n_classes)]


def wide_weights(weights: DataFrame, n_classes: int, value_col: str = "w", term_col: str = "term",
                 prefix: str = "w") -> DataFrame:
    """``(term, w_0 … w_{K-1})``: one row per term (K × |V| numbers in total)."""
    aggs = [F.sum(F.when(F.col("class_no") == k, F.col(value_col))).alias(f"{prefix}_{k}") for k in range(n_classes)]
    return weights.groupBy(term_col).agg(*aggs).na.fill(0.0)


# ---------------------------------------------------------------- softmax helpers
def softmax(logits: Column) -> Column:
    m = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum (lowest class wins ties)."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def _per_doc_sums(features: DataFrame, wide: DataFrame, docs: DataFrame | None, n_classes: int,
                  exprs: dict[str, tuple[str, int]], term_col: str = "term", group=("doc_id",)) -> DataFrame:
    """Sum ``x ** power * {prefix}_k`` per document for every class k, for each ``exprs[name] =
    (prefix, power)``.

    Documents without any feature still get a row: their ids are unioned in with
    zeros, so no join against the document table is needed. Packed features are summed
    in their row if the weight table is below the broadcast limit; with ``docs`` None they
    hold a row for every document, and nothing is added.
    """
    parts = [(f"{name}_{k}", f"{prefix}_{k}", power) for name, (prefix, power) in exprs.items() for k in range(n_classes)]
    table = P.small_table(wide) if P.is_packed(features, term_col) else None
    if table is not None:
        part = features.select(*group, P.sums(table, [(c, power) for _, c, power in parts], term_col).alias("_s")).select(
            *group, *[F.col("_s")[i].alias(n) for i, (n, _, _) in enumerate(parts)])
    else:
        rows = P.unpack(features.select(*group, term_col, "x"), (term_col, "x")) if P.is_packed(features, term_col) else features
        joined = rows.join(checked_broadcast(wide), term_col)
        part = joined.select(*group, *[((F.col("x") * F.col("x") if power == 2 else F.col("x")) * F.col(c)).alias(n) for n, c, power in parts])
    if docs is None and table is None:
        docs = features
    if docs is not None:
        part = part.unionByName(docs.select(*group, *[F.lit(0.0).alias(n) for n, _, _ in parts]))
    return part.groupBy(*group).agg(*[F.sum(n).alias(n) for n, _, _ in parts])


def score_probabilities(features: DataFrame, weights: DataFrame, bias: DataFrame, docs: DataFrame,
                        n_classes: int, term_col: str = "term") -> DataFrame:
    """``(doc_id, logits array, probs array)``; docs = the document ids to score."""
    wide = wide_weights(weights, n_classes, term_col=term_col)
    b = bias_list(bias, n_classes)
    sums = _per_doc_sums(features, wide, docs, n_classes,
                         {"s": ("w", 1)}, term_col)
    logits = F.array(*[F.col(f"s_{k}") + F.lit(b[k]) for k in range(n_classes)])
    return sums.select("doc_id", logits.alias("logits")).withColumn("probs", softmax(F.col("logits")))


def score_continuous(features: DataFrame, weights: DataFrame, intercept: float, docs: DataFrame,
                     term_col: str = "term") -> DataFrame:
    """One-output linear score ``(doc_id, score)``."""
    sums = _per_doc_sums(features, weights.select(term_col, F.col("w").alias("w_0")), docs, 1,
                         {"s": ("w", 1)}, term_col)
    return sums.select("doc_id", (F.col("s_0") + F.lit(float(intercept))).alias("score"))


def long_probs(scored: DataFrame) -> DataFrame:
    """Wide arrays → ``(doc_id, class_no, logit, prob)`` (no shuffle)."""
    return scored.select("doc_id", F.posexplode(F.arrays_zip("logits", "probs")).alias("class_no", "z")) \
                 .select("doc_id", F.col("class_no").cast("int").alias("class_no"),
                         F.col("z.logits").alias("logit"), F.col("z.probs").alias("prob"))


def aggregate_chunks(chunk_scores: DataFrame, n_classes: int, unc_col: str | None = None) -> DataFrame:
    """Mean probability per document over its chunks; mean of non-null uncertainties.

    ``chunk_scores`` is ``(doc_id, chunk_no, probs[, unc])``. One ``groupBy(doc_id)``
    with K averages (null uncertainties are skipped by ``avg``).
    """
    aggs = [F.avg(F.col("probs")[k]).alias(f"p_{k}") for k in range(n_classes)]
    if unc_col:
        aggs += [F.avg(F.col(unc_col)[k]).alias(f"u_{k}") for k in range(n_classes)]
    g = chunk_scores.groupBy("doc_id").agg(*aggs, F.count(F.lit(1)).alias("n_chunks"))
    out = g.select("doc_id", "n_chunks", F.array(*[F.col(f"p_{k}") for k in range(n_classes)]).alias("probs"),
                   *([F.when(F.coalesce(*[F.col(f"u_{k}") for k in range(n_classes)]).isNotNull(),
                             F.array(*[F.col(f"u_{k}") for k in range(n_classes)])).alias("unc")] if unc_col else []))
    return out


# ---------------------------------------------------------------- MC dropout
def _keeps(prefix, term, sample: int, p: float, seed: int) -> Column:
    """Whether ``common.unit_hash(doc, term, sample, seed)`` is ≥ p. ``prefix`` is ``doc:``; the
    hash's first 8 hexadecimal digits are compared as text, in which they order as numbers do."""
    least = math.ceil(p * 2 ** 32)
    if least <= 0 or least >= 1 << 32:
        return F.lit(least <= 0)
    return F.md5(F.concat(prefix, term, F.lit(f":{sample}:{seed}"))) >= F.lit(f"{least:08x}")


def _pass_sums(features: DataFrame, wide: DataFrame, docs: DataFrame, columns: list[str], names: list[list[str]],
               p: float, seed: int, term_col: str) -> DataFrame:
    """Per document one sum of kept and scaled contributions for each pass and column."""
    n_samples, flat = len(names), [n for row in names for n in row]
    prefix = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(""))
    rows = features.withColumn("_id", prefix)
    packed = P.is_packed(features, term_col)
    table = P.small_table(wide) if packed and n_samples < 63 else None
    if table is not None:
        bits = F.transform(term_col, lambda t: sum((F.when(_keeps(F.col("_id"), t, i + 1, p, seed), F.lit(1 << i)).otherwise(0).cast("long")
                                                    for i in range(1, n_samples)),
                                                   F.when(_keeps(F.col("_id"), t, 1, p, seed), F.lit(1)).otherwise(0).cast("long")))
        each = P.masked_sums(table, columns, bits, n_samples, term_col)
        kept = rows.select("doc_id", each.alias("_s")).select("doc_id", *[(F.col("_s")[i] / F.lit(1.0 - p)).alias(n) for i, n in enumerate(flat)])
    else:
        long = P.unpack(rows.select("doc_id", "_id", term_col, "x"), (term_col, "x")) if packed else rows
        joined = long.join(checked_broadcast(wide), term_col)
        masked = joined.select("doc_id", *[(F.col("x") * F.col(c) / F.lit(1.0 - p)).alias(f"v_{k}") for k, c in enumerate(columns)],
                               *[_keeps(F.col("_id"), F.col(term_col), i + 1, p, seed).alias(f"keep_{i}") for i in range(n_samples)])
        kept = masked.select("doc_id", *[F.when(F.col(f"keep_{i}"), F.col(f"v_{k}")).otherwise(0.0).alias(n)
                                         for i, row in enumerate(names) for k, n in enumerate(row)])
    zeros = docs.select("doc_id", *[F.lit(0.0).alias(n) for n in flat])
    return kept.unionByName(zeros).groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in flat])


def mc_dropout(features: DataFrame, weights: DataFrame, bias: DataFrame, docs: DataFrame,
               n_classes: int, n_samples: int = 10, p: float = 0.1, seed: int = 42,
               term_col: str = "term") -> DataFrame:
    """Monte-Carlo dropout on the classifier input: ``n`` passes, each feature kept when
    a seeded hash of ``doc:term:sample:seed`` is ≥ p and scaled by 1/(1−p). Returns
    ``(doc_id, class_no, mc_mean, mc_std)`` with the population std across passes.

    All passes of a feature are evaluated in its row (one masked value per pass and class), so
    the features are joined once and one aggregate per document holds all passes; a document
    that loses every feature in a pass keeps its bias-only logits through the zero row.
    """
    wide = wide_weights(weights, n_classes, term_col=term_col)
    b = bias_list(bias, n_classes)
    passes, classes = range(1, n_samples + 1), range(n_classes)
    sums = _pass_sums(features, wide, docs, [f"w_{k}" for k in classes], [[f"s_{i}_{k}" for k in classes] for i in passes], p, seed, term_col)
    probs = F.array(*[softmax(F.array(*[F.col(f"s_{i}_{k}") + F.lit(b[k]) for k in classes])) for i in passes])

    def mean(k: int) -> Column:
        return F.aggregate("probs", F.lit(0.0), lambda a, v: a + v[k]) / n_samples

    def spread(k: int) -> Column:
        return F.sqrt(F.aggregate("probs", F.lit(0.0), lambda a, v: a + (v[k] - F.col(f"m_{k}")) * (v[k] - F.col(f"m_{k}"))) / n_samples)

    rows = sums.select("doc_id", probs.alias("probs")).select("doc_id", "probs", *[mean(k).alias(f"m_{k}") for k in classes])
    each = F.array(*[F.struct(F.lit(k).alias("class_no"), F.col(f"m_{k}").alias("mc_mean"), spread(k).alias("mc_std")) for k in classes])
    return rows.select("doc_id", F.explode(each).alias("c")).select("doc_id", "c.class_no", "c.mc_mean", "c.mc_std")


def mc_dropout_scores(features: DataFrame, weights: DataFrame, intercept: float, docs: DataFrame,
                      n_samples: int = 10, p: float = 0.1, seed: int = 42, term_col: str = "term") -> DataFrame:
    """Monte-Carlo dropout of a one-output model: ``(doc_id, mc_mean, mc_std)`` of the raw score
    (no softmax), with the masks of :func:`mc_dropout` and the population std across passes.

    All passes of a feature are evaluated in its row, so the features are read once and
    one aggregate per document holds one sum per pass.
    """
    sums = _pass_sums(features, weights.select(term_col, "w"), docs, ["w"], [[f"s_{i}"] for i in range(1, n_samples + 1)], p, seed, term_col)
    scores = F.array(*[F.col(f"s_{i}") + F.lit(float(intercept)) for i in range(1, n_samples + 1)])
    mean = F.aggregate("scores", F.lit(0.0), lambda a, v: a + v) / n_samples
    spread = F.aggregate("scores", F.lit(0.0), lambda a, v: a + (v - F.col("mc_mean")) * (v - F.col("mc_mean"))) / n_samples
    return (sums.select("doc_id", scores.alias("scores")).withColumn("mc_mean", mean)
                .select("doc_id", "mc_mean", F.sqrt(spread).alias("mc_std")))


def mc_dropout_columns(mc: DataFrame, labels: list[str] | None = None, continuous: bool = False) -> DataFrame:
    """Wide MC output: ``MC Continuous Mean/Std`` or ``MC Mean/Std Probability Dist i: label``
    (classes numbered from 1)."""
    if continuous:
        # One output: the table of ``mc_dropout_scores``.
        return mc.select("doc_id", F.col("mc_mean").alias("MC Continuous Mean"),
                         F.col("mc_std").alias("MC Continuous Std"))
    ks = sorted({int(r[0]) for r in mc.select("class_no").distinct().collect()}) if labels is None else range(len(labels))
    names = {k: (labels[k] if labels else f"Class_{k + 1}") for k in ks}
    aggs = []
    for k in ks:
        aggs.append(F.max(F.when(F.col("class_no") == k, F.col("mc_mean"))).alias(f"MC Mean Probability Dist {k + 1}: {names[k]}"))
        aggs.append(F.max(F.when(F.col("class_no") == k, F.col("mc_std"))).alias(f"MC Std Probability Dist {k + 1}: {names[k]}"))
    return mc.groupBy("doc_id").agg(*aggs)


# ---------------------------------------------------------------- Fisher information
def batch_gradients(features: DataFrame, scored: DataFrame, labels: DataFrame, batches: DataFrame,
                    n_classes: int, term_col: str = "term") -> tuple[DataFrame, DataFrame]:
    """Mean cross-entropy gradients per batch: weights ``(batch, class_no, term, g)``
    and bias ``(batch, class_no, g)``; ``g = mean over batch docs of (p − y)·x``.

    ``batches`` is ``(doc_id, batch)``; residuals are per document (K numbers), the
    weight gradient is one ``groupBy(batch, class, term)`` aggregate (map-side combine).
    Packed features give packed weight gradients (:func:`packed.gradients`): only documents
    move to their batch.
    """
    # K numbers a document, read by both gradients: the documents are scored once.
    res = reuse(scored.join(labels, "doc_id").join(batches, "doc_id")
                      .select("doc_id", "batch", F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                              lambda k: F.col("probs")[k] - F.when(F.col("label") == k, 1.0).otherwise(0.0)).alias("r")))
    sizes = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("bs"))
    gb = (res.groupBy("batch").agg(F.array(*[F.sum(F.col("r")[k]) for k in range(n_classes)]).alias("gs"))
             .join(sizes, "batch")
             .select("batch", F.posexplode("gs").alias("class_no", "gs"), "bs")
             .select("batch", F.col("class_no").cast("int").alias("class_no"), (F.col("gs") / F.col("bs")).alias("g")))
    if P.is_packed(features, term_col):
        return P.gradients(features.withColumnRenamed(term_col, "term").join(res.join(sizes, "batch"), "doc_id"), n_classes).withColumnRenamed("term", term_col), gb
    # One residual row per document joins its feature rows; K sums per (batch, term).
    gsum = (features.join(res, "doc_id")
                    .groupBy("batch", term_col)
                    .agg(F.array(*[F.sum(F.col("r")[k] * F.col("x")) for k in range(n_classes)]).alias("gs")))
    gw = (gsum.join(sizes, "batch")
              .select("batch", term_col, F.posexplode("gs").alias("class_no", "gs"), "bs")
              .select("batch", F.col("class_no").cast("int").alias("class_no"), term_col,
                      (F.col("gs") / F.col("bs")).alias("g")))
    return gw, gb


def fisher_accumulate(grads: DataFrame, n_batches: int, beta2: float = 0.999,
                      keys=("class_no", "term")) -> DataFrame:
    """Closed form of the optimiser's squared-gradient moving average after T steps:
    ``FIM = (1−β2)/(1−β2^T) · Σ_s β2^(T−1−s) · g_s²`` (batches numbered 0…T−1)."""
    T = int(n_batches)
    c = (1.0 - beta2) / (1.0 - beta2 ** T) if T > 0 else 0.0
    wt = F.pow(F.lit(beta2), F.lit(T - 1) - F.col("batch"))
    if "term" in keys and P.is_packed(grads):
        # A term's rows are summed for all classes before they are told apart.
        names = [c for c in grads.columns if c.startswith("g_")]
        each = [F.lit(c) * F.sum(wt * F.col(g) * F.col(g)) for g in names]
        return P.unpack(grads, ("term", *names)).groupBy("term").agg(F.array(*each).alias("f")).select(
            "term", F.posexplode("f").alias("class_no", "fim")).select(F.col("class_no").cast("int").alias("class_no"), "term", "fim")
    return grads.groupBy(*keys).agg((F.lit(c) * F.sum(wt * F.col("g") * F.col("g"))).alias("fim"))


def fisher_variance(fim: DataFrame, invert: bool = True) -> DataFrame:
    """``variance = 1/(FIM + 1e-12)``; NaN/inf → 1e8. ``invert=False`` keeps FIM."""
    if not invert:
        return fim.withColumn("variance", F.col("fim"))
    v = F.lit(1.0) / (F.col("fim") + F.lit(1e-12))
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf"))) | F.col("fim").isNull()
    return fim.withColumn("variance", F.when(bad, F.lit(1e8)).otherwise(v))


def softmax_uncertainty(features: DataFrame, weights: DataFrame, bias: DataFrame, w_var: DataFrame,
                        b_var: DataFrame | None, docs: DataFrame, n_classes: int,
                        consider_bias: bool = True, term_col: str = "term") -> DataFrame:
    """Probabilities and their propagated variance per document (arrays of K).

    ``z_j = Σ_k x_k²·var(w_jk) + var(b_j)``;
    ``var(p_i) = p_i²·[z_i(1−p_i)² + Σ_{j≠i} p_j² z_j]``. Logits and z are summed in the
    same per-document aggregate.
    """
    wide = wide_weights(weights, n_classes, term_col=term_col).join(
        wide_weights(w_var.select("class_no", term_col, F.col("variance").alias("w")), n_classes,
                     term_col=term_col, prefix="v"), term_col, "left").na.fill(0.0)
    b = bias_list(bias, n_classes)
    bv = [0.0] * n_classes
    # Without the bias variance the store is incomplete and the uncertainty is all zero.
    incomplete = consider_bias and b_var is None
    if consider_bias and b_var is not None:
        bv = bias_list(b_var.select("class_no", F.col("variance").alias("b")), n_classes)
    sums = _per_doc_sums(features, wide, docs, n_classes,
                         {"s": ("w", 1), "z": ("v", 2)}, term_col)
    probs = softmax(F.array(*[F.col(f"s_{k}") + F.lit(b[k]) for k in range(n_classes)]))
    z = F.array(*[F.col(f"z_{k}") + F.lit(bv[k]) for k in range(n_classes)])
    out = sums.select("doc_id", probs.alias("probs"), z.alias("z"))
    cross = F.aggregate(F.zip_with("probs", "z", lambda p, zz: p * p * zz), F.lit(0.0), lambda a, v: a + v)
    var = F.zip_with("probs", "z", lambda p, zz: p * p * (zz * (1 - p) * (1 - p) + (cross - p * p * zz)))
    if incomplete:
        var = F.transform("probs", lambda p: F.lit(0.0))
    return out.select("doc_id", "probs", var.alias("variance"))


def finetune_results(gold: DataFrame, scored: DataFrame, uncertainty: DataFrame | None = None) -> DataFrame:
    """``doc_id, gold_label, prob_distribution, diamond_uncertainty`` (arrays) of the scored rows of ``gold``.

    A row without a stored uncertainty, or a run without any, has a null one.
    """
    out = gold.select("doc_id", "gold_label").join(scored.select("doc_id", F.col("probs").alias("prob_distribution")), "doc_id")
    if uncertainty is None:
        return out.withColumn("diamond_uncertainty", F.lit(None).cast("array<double>"))
    return out.join(uncertainty.select("doc_id", F.col("variance").alias("diamond_uncertainty")), "doc_id", "left")


def probability_interval(unc: DataFrame) -> DataFrame:
    """Per document and class: ``std = sqrt(max(var, 1e-15))``, mean ± 2 std; per
    document the shared range [min lo, max hi] widened by 10 % (−0.5…1.5 when flat)."""
    rows = unc.select("doc_id", F.posexplode(F.arrays_zip("probs", "variance")).alias("class_no", "z")).select(
        "doc_id", F.col("class_no").cast("int").alias("class_no"), F.col("z.probs").alias("mean"),
        F.sqrt(F.greatest(F.col("z.variance"), F.lit(1e-15))).alias("std"))
    rows = rows.withColumn("lo", F.col("mean") - 2 * F.col("std")).withColumn("hi", F.col("mean") + 2 * F.col("std"))
    w = Window.partitionBy("doc_id")   # K rows per document
    lo, hi = F.min("lo").over(w), F.max("hi").over(w)
    pad = (hi - lo) * 0.1
    flat = (hi - lo) == 0
    return rows.select("doc_id", "class_no", "mean", "std", "lo", "hi",
                       F.when(flat, F.lit(-0.5)).otherwise(lo - pad).alias("range_lo"),
                       F.when(flat, F.lit(1.5)).otherwise(hi + pad).alias("range_hi"))
