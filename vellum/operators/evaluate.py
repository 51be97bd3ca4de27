"""Evaluation and ablation: metrics, slice F1, parameter masking curves, variance reports.

Metrics are computed from confusion counts (``groupBy(keys, label, pred)``), so a whole
family of evaluations (one per retained fraction, per removed bias, per slice) is one
aggregate keyed by the family column rather than a driver loop of separate jobs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.common import reuse
from vellum.operators.ranking import global_index


def weighted_f1(pairs: DataFrame, keys=(), label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Accuracy and support-weighted F1 per ``keys`` from ``(keys…, label, pred)`` rows.

    Undefined per-class F1 (no predictions and no support) counts as 0.
    """
    keys = list(keys)
    # Each (label, pred) row counts once as support of its label and once as a
    # prediction of its class: one generator + one aggregate, no self-joins, so the
    # (possibly expensive) plan behind ``pairs`` runs once.
    roles = F.explode(F.array(
        F.struct(F.col(label_col).alias("cls"), F.lit(1).alias("s"), F.lit(0).alias("p"),
                 (F.col(label_col) == F.col(pred_col)).cast("int").alias("t")),
        F.struct(F.col(pred_col).alias("cls"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t"))))
    per = (pairs.select(*keys, roles.alias("r"))
                .groupBy(*keys, F.col("r.cls").alias("cls"))
                .agg(F.sum("r.s").alias("support"), F.sum("r.p").alias("npred"), F.sum("r.t").alias("tp"))
                .withColumn("f1", F.coalesce(2.0 * F.col("tp") / F.nullif(F.col("npred") + F.col("support"), F.lit(0)),
                                             F.lit(0.0))))
    agg = per.groupBy(*keys) if keys else per.groupBy()
    return agg.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                   (F.sum(F.col("support") * F.col("f1")) / F.sum("support")).alias("weighted_f1"),
                   F.sum("support").cast("long").alias("n"))


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", keys=()) -> DataFrame:
    """MSE, MAE and R² (1 − SSE/SST)."""
    g = df.groupBy(*keys) if keys else df.groupBy()
    d = F.col(yhat) - F.col(y)
    return g.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"),
                 (1 - F.avg(d * d) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"))


def cross_entropy(probs_col: str = "probs", label_col: str = "label"):
    return -F.log(F.element_at(F.col(probs_col), F.col(label_col) + 1))


def huber(d, beta: float = 1.0):
    ad = F.abs(d)
    return F.when(ad < beta, 0.5 * d * d / beta).otherwise(ad - 0.5 * beta)


def slice_f1(pairs: DataFrame, n_slices: int, order_col: str = "doc_id", chosen: float | None = None) -> DataFrame:
    """Cut the rows (in key order) into ``n`` slices of ``total // n`` rows, the last one
    taking the rest; weighted F1 per slice, plus their mean, population std and the
    z-score of ``chosen`` (default: F1 over all rows)."""
    pairs = reuse(pairs)
    total = pairs.count()
    size = max(total // n_slices, 1)
    idx = global_index(pairs, [F.col(order_col)], "_i")
    sl = idx.withColumn("slice", F.least(F.floor(F.col("_i") / size), F.lit(n_slices - 1)).cast("int"))
    per = weighted_f1(sl, ["slice"])
    overall = weighted_f1(pairs).first()["weighted_f1"] if chosen is None else chosen
    stats = per.agg(F.avg("weighted_f1").alias("mean_f1"), F.stddev_pop("weighted_f1").alias("std_f1")).first()
    z = (overall - stats["mean_f1"]) / max(stats["std_f1"], 1e-12)
    pairs.unpersist()  # the slices are checkpointed
    return per.select("slice", "weighted_f1", "n",
                      F.lit(stats["mean_f1"]).alias("mean_f1"), F.lit(stats["std_f1"]).alias("std_f1"),
                      F.lit(float(overall)).alias("chosen_f1"), F.lit(float(z)).alias("z"))


def retention_schedule(step=0.1) -> list[float]:
    """Decreasing kept fractions, integer-stepped (no float drift), ending at 0.0 once.

    ``step`` is one number, or ``(coarse, fine, pivot)``: coarse steps down to the
    pivot, fine steps below it.
    """
    if isinstance(step, (tuple, list)):
        coarse, fine, pivot = step
        n_top = int(math.floor(round((1.0 - pivot) / coarse, 6)))
        n_low = int(math.floor(round(pivot / fine, 6)))
        top = [round(1.0 - i * coarse, 6) for i in range(n_top + 1)]
        low = [round(pivot - i * fine, 6) for i in range(1, n_low + 1)]
        vals = top + [round(pivot, 6)] + low + [0.0]
    else:
        n = int(round(1.0 / step))
        vals = [round(1.0 - i * step, 6) for i in range(n + 1)] + [0.0]
    out = []
    for v in vals:
        v = max(v, 0.0)
        if v not in out:
            out.append(v)
    return out


def keep_lowest_variance(variance: DataFrame, fraction, order=("class_no", "term"),
                         group: str | None = None) -> DataFrame:
    """Rows of the parameter table with the smallest variance: ``max(1, floor(n·N))``
    of them (ties by the order keys); ``fraction ≥ 1`` or ``'auto'`` keeps all.
    Ranks come from :func:`global_index` (no single-task window)."""
    if group is not None and "param" in variance.columns:
        variance = variance.filter(F.col("param") == group)
    if fraction == "auto" or float(fraction) >= 1.0:
        return variance
    n_params = variance.count()
    keep = max(1, int(math.floor(float(fraction) * n_params)))
    ranked = global_index(variance, [F.col("variance")] + [F.col(c) for c in order], "_r")
    return ranked.filter(F.col("_r") < keep).drop("_r")


def ranked_parameters(variance: DataFrame, order=("class_no", "term")) -> DataFrame:
    """Variance table with its 0-based rank by ascending variance (``rank``) and ``N``."""
    return global_index(variance, [F.col("variance")] + [F.col(c) for c in order], "rank")


def variance_by_group(variance: DataFrame, labels: list[str] | None = None, floor: float = 1e-15) -> DataFrame:
    """Mean parameter variance on a log10 scale: ``param, class_no, class_name, log10_mean, log10_floored``.

    One row per parameter tensor (class −1, ``all``) and one per class bias, named by
    ``labels`` or ``Bias_i`` (from 1).
    """
    def logs(df: DataFrame) -> DataFrame:
        return df.select("param", "class_no", "class_name", F.log10("mv").alias("log10_mean"),
                         F.log10(F.greatest(F.lit(floor), F.col("mv"))).alias("log10_floored"))
    tensors = variance.groupBy("param").agg(F.avg("variance").alias("mv")).withColumn("class_no", F.lit(-1)).withColumn("class_name", F.lit("all"))
    number = (F.col("class_no") + 1).cast("string")
    name = F.concat(F.lit("Bias_"), number)
    if labels:
        name = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in labels]), F.col("class_no") + 1), name)
    bias = variance.filter(F.col("param") == "bias").select("param", "class_no", name.alias("class_name"), F.col("variance").alias("mv"))
    return logs(tensors.select("param", "class_no", "class_name", "mv")).unionByName(logs(bias))


def histogram(values: DataFrame, value_col: str = "variance", bins: int = 50, keys=()) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed) per ``keys``: ``(keys…, bin, lo, hi, n)``.
    Empty bins are omitted."""
    keys = list(keys)
    if keys:
        rng = values.groupBy(*keys).agg(F.min(value_col).alias("vmin"), F.max(value_col).alias("vmax"))
        joined = values.join(F.broadcast(rng), keys)   # one row per key group
    else:
        lo_hi = values.agg(F.min(value_col), F.max(value_col)).first()
        joined = values.withColumn("vmin", F.lit(lo_hi[0])).withColumn("vmax", F.lit(lo_hi[1]))
    width = (F.col("vmax") - F.col("vmin")) / bins
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value_col) - F.col("vmin")) / width), F.lit(bins - 1))).cast("int")
    out = joined.withColumn("bin", b).groupBy(*keys, "bin", "vmin", "vmax").agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "bin", (F.col("vmin") + F.col("bin") * (F.col("vmax") - F.col("vmin")) / bins).alias("lo"),
                      (F.col("vmin") + (F.col("bin") + 1) * (F.col("vmax") - F.col("vmin")) / bins).alias("hi"), "n")


def log_histogram(values: DataFrame, value_col: str = "variance", keys=()) -> DataFrame:
    """Bins ``[0,1), [1,10), …, [10^(m−1), 10^m]`` with ``m = ceil(log10(max(1, max)))``
    per ``keys`` (the last bin is closed); ``(keys…, bin, lo, hi, n)``."""
    keys = list(keys)
    v = F.col(value_col)
    if keys:
        mx = values.groupBy(*keys).agg(F.max(value_col).alias("_mx"))
        values = values.join(F.broadcast(mx), keys)          # one row per key group
        m = F.ceil(F.log10(F.greatest(F.lit(1.0), F.col("_mx"))))
    else:
        m = F.ceil(F.log10(F.greatest(F.lit(1.0), F.lit(values.agg(F.max(value_col)).first()[0]))))
    b = F.when(v < 1, F.lit(0)).otherwise(F.least(F.floor(F.log10(v)) + 1, m)).cast("int")
    out = values.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "bin", F.when(F.col("bin") == 0, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), F.col("bin") - 1)).alias("lo"),
                      F.pow(F.lit(10.0), F.col("bin")).alias("hi"), "n")
