"""Training: linear models and the Fisher-preconditioned optimiser.

The optimiser's state is a table with one row per parameter (weight, momentum, Fisher
diagonal). A step joins the batch's gradient table to it and updates the columns; only
two root-mean-squares per parameter tensor come to the driver. The state is checkpointed
every step, so a lost executor costs no step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators import linear as LN
from vellum.operators import packed as P
from vellum.operators import scoring as SC
from vellum.operators.common import key_hash


def train_classifier(df: DataFrame, features_col: str = "features", label_col: str = "label", max_passes: int = 60,
                     reg: float = 1e-3, init: LN.Linear | None = None) -> LN.Linear:
    """Multinomial classifier (cross-entropy) on a vector column; ``init`` (a stored version, see
    :func:`linear.load`) starts the fit from its weights."""
    return LN.fit(df, "softmax", features_col, label_col, init=None if init is None else init.weights, reg=reg, max_passes=max_passes)


def train_regressor(df: DataFrame, features_col: str = "features", label_col: str = "y", max_passes: int = 60,
                    reg: float = 0.0, init: LN.Linear | None = None) -> LN.Linear:
    """Single-output regression with the smooth-L1 loss (beta 1, no fitted scale)."""
    return LN.fit(df, "smooth_l1", features_col, label_col, init=None if init is None else init.weights, reg=reg, max_passes=max_passes)


@dataclass(frozen=True)
class FisherAdam:
    """Settings of natural-gradient Adam with a diagonal empirical Fisher matrix.

    A direction (the gradient, or the parameters themselves for the decay) is divided by
    ``fisher ** power + epsilon`` and scaled down where its root mean square exceeds 1.
    """

    rate: float = 0.5
    momentum: float = 0.9
    memory: float = 0.999
    decay: float = 0.1
    clip: float = 1.0
    power: float = 0.5
    epsilon: float = 1e-8

    def memory_at(self, step: int) -> float:
        """Share of the old Fisher diagonal at a step: none at the first, ``memory`` in the limit."""
        return self.memory * (1 - self.memory ** (step - 1)) / (1 - self.memory ** step)

    def update(self, state: DataFrame, gradients: DataFrame, step: int) -> DataFrame:
        """State after one step. ``state``: ``param, class_no, term, value, moment, fisher``;
        ``gradients``: ``param, class_no, term, g`` (a parameter without a row has gradient 0)."""
        key = ["param", "class_no", "term"]
        keep = self.memory_at(step)
        now = (state.join(gradients, key, "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
                    .withColumn("fisher", keep * F.col("fisher") + (1 - keep) * F.col("g") * F.col("g"))
                    .checkpoint(eager=True))
        floor = {p: self.epsilon * min(1.0, r["g"]) for p, r in _rms(now, g=F.col("g")).items()}
        base = F.pow("fisher", F.lit(self.power)) + _by_param(floor)
        size = _rms(now, push=F.col("g") / base, pull=F.col("value") / base)
        push = F.col("g") / base * _by_param({p: self.clip / max(1.0, r["push"]) for p, r in size.items()})
        pull = F.col("value") / base * _by_param({p: self.clip / max(1.0, r["pull"]) for p, r in size.items()})
        moment = self.momentum * F.col("moment") + (1 - self.momentum) * push
        decay = F.when(F.col("param") == "weight", self.decay * pull).otherwise(0.0)
        return now.select(*key, (F.col("value") - self.rate * (moment + decay)).alias("value"), moment.alias("moment"), "fisher")


def _rms(table: DataFrame, **columns: Column) -> dict[str, dict[str, float]]:
    """Root mean square of each column over each parameter tensor."""
    rows = table.groupBy("param").agg(*[F.sqrt(F.avg(c * c)).alias(n) for n, c in columns.items()]).collect()
    return {r["param"]: {n: r[n] for n in columns} for r in rows}


def _by_param(values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for param, value in values.items():
        out = F.when(F.col("param") == param, F.lit(value)).otherwise(out)
    return out


def initial_state(vocab: DataFrame, n_classes: int, weights: DataFrame | None = None, bias: DataFrame | None = None) -> DataFrame:
    """Zero parameters, or those of ``weights`` (``class_no, term, w``) and ``bias`` (``class_no, b``)."""
    classes = F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("class_no")
    w = vocab.select(F.lit("weight").alias("param"), classes, "term")
    b = vocab.sparkSession.createDataFrame([("bias", k, "") for k in range(n_classes)], "param string, class_no int, term string")
    w = w.join(weights.select("class_no", "term", F.col("w").alias("value")), ["class_no", "term"], "left") if weights is not None else w.withColumn("value", F.lit(0.0))
    b = b.join(bias.select("class_no", F.col("b").alias("value")), "class_no", "left") if bias is not None else b.withColumn("value", F.lit(0.0))
    state = w.select("param", "class_no", "term", "value").unionByName(b.select("param", "class_no", "term", "value"))
    return state.select("param", "class_no", "term", F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(0.0).alias("moment"), F.lit(1.0).alias("fisher"))


def model_tables(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(class_no, term, w)`` and ``(class_no, b)`` of a state."""
    return (state.filter("param = 'weight'").select("class_no", "term", F.col("value").alias("w")),
            state.filter("param = 'bias'").select("class_no", F.col("value").alias("b")))


def _residuals(state: DataFrame, features: DataFrame, labels: DataFrame, docs: DataFrame, n_classes: int) -> DataFrame:
    """``doc_id, r`` (probabilities minus the true class) and ``loss`` of the given documents."""
    weights, bias = model_tables(state)
    rows = features.join(docs.select("doc_id"), "doc_id", "left_semi")
    scored = SC.score_probabilities(rows, weights, bias, docs.select("doc_id"), n_classes).join(labels.select("doc_id", "label"), "doc_id")
    true = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: (F.col("label") == k).cast("double"))
    return scored.select("doc_id", F.zip_with("probs", true, lambda p, y: p - y).alias("r"),
                         (-F.log(F.element_at("probs", F.col("label") + 1))).alias("loss"))


def _gradients(residuals: DataFrame, features: DataFrame, n: int, n_classes: int) -> DataFrame:
    """Mean cross-entropy gradient: ``param, class_no, term, g``."""
    each = [F.sum(F.col("r")[k] * F.col("x")).alias(str(k)) for k in range(n_classes)]
    rows = features.join(residuals.select("doc_id", "r"), "doc_id")
    rows = (P.unpack(rows) if P.is_packed(rows) else rows).groupBy("term").agg(F.array(*each).alias("s"))
    total = residuals.agg(F.array(*[F.sum(F.col("r")[k]) for k in range(n_classes)]).alias("s"))
    both = rows.select(F.lit("weight").alias("param"), "term", "s").unionByName(total.select(F.lit("bias").alias("param"), F.lit("").alias("term"), "s"))
    return both.select("param", "term", F.posexplode("s").alias("class_no", "g")).select("param", F.col("class_no").cast("int").alias("class_no"), "term", (F.col("g") / n).alias("g"))


def train_fisher_adam(features: DataFrame, labels: DataFrame, vocab: DataFrame, n_classes: int, train_docs: DataFrame,
                      eval_docs: DataFrame | None = None, settings: FisherAdam = FisherAdam(), epochs: int = 3,
                      n_batches: int = 4, seed: int = 42, init: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Train the linear softmax scorer; returns the log and the state after each epoch.

    Batches are key-hash buckets of the training documents (deterministic); an empty one
    is passed over. The log has ``epoch, step, loss, eval_loss``; evaluation computes the
    loss only. ``init`` is a state to go on from.
    """
    spark = features.sparkSession
    state = initial_state(vocab, n_classes) if init is None else init
    batches = train_docs.select("doc_id", (key_hash(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))) % n_batches).alias("batch"))
    log, states, step = [], [], 0
    for epoch in range(1, epochs + 1):
        losses = []
        for batch in range(n_batches):
            docs = batches.filter(F.col("batch") == batch).select("doc_id")
            residuals = _residuals(state, features, labels, docs, n_classes).checkpoint(eager=True)
            n, loss = residuals.agg(F.count(F.lit(1)), F.avg("loss")).first()
            if n:
                step += 1
                state = settings.update(state, _gradients(residuals, features, n, n_classes), step)
                losses.append(loss)
        state = state.checkpoint(eager=True)
        states.append(state)
        eval_loss = None
        if eval_docs is not None:
            eval_loss = _residuals(state, features, labels, eval_docs.select("doc_id"), n_classes).agg(F.avg("loss")).first()[0]
        log.append((float(epoch), step, sum(losses) / len(losses) if losses else None, eval_loss))
    return spark.createDataFrame(log, "epoch double, step long, loss double, eval_loss double"), states


def best_epoch(log_df: DataFrame) -> DataFrame:
    """The epoch with the lowest eval loss (ties: the earlier epoch) and its step."""
    return log_df.filter(F.col("eval_loss").isNotNull()).agg(
        F.min_by(F.struct("epoch", "step", "eval_loss"), F.struct("eval_loss", "epoch")).alias("best")).select("best.*")


def best_state(log_df: DataFrame, states: list[DataFrame]) -> DataFrame:
    """The parameters after the epoch of lowest eval loss."""
    return states[int(best_epoch(log_df).first()["epoch"]) - 1]


def flatten_log_history(state_json: DataFrame) -> DataFrame:
    """One row per entry of a stored trainer log (``log_history`` array); ``best_epoch`` reads it."""
    return state_json.select(F.explode("log_history").alias("h")).select("h.*")
