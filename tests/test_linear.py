"""Linear fits over aggregated gradients: optima, warm start from a stored version, odd rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from vellum.operators import linear as LN
from vellum.operators import train as TR


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 6)) * (rng.random((240, 6)) < 0.7)
    z = x @ rng.normal(size=(6, 3))
    label = (z + rng.gumbel(size=z.shape)).argmax(axis=1)
    y = x @ rng.normal(size=6) + 0.7 + np.where(rng.random(240) < 0.15, rng.normal(0, 15, 240), rng.normal(0, 0.3, 240))
    return x, label, y


def table(spark, x, target):
    rows = [(i, Vectors.sparse(x.shape[1], [(int(j), float(v[j])) for j in np.flatnonzero(v)]), float(t)) for i, (v, t) in enumerate(zip(x, target, strict=True))]
    return spark.createDataFrame(rows, ["doc_id", "features", "target"]).repartition(4)


def gradient(x, target, w, loss, reg):
    z = x @ w[:-1] + w[-1]
    value, g = loss(z, target)
    pull = np.vstack([w[:-1], np.zeros((1, w.shape[1]))])
    return value / len(x) + reg / 2 * (pull ** 2).sum(), np.vstack([x.T @ g, g.sum(0)]) / len(x) + reg * pull


@pytest.mark.parametrize("kind", ["softmax", "smooth_l1"])
def test_fit_reaches_the_optimum(spark, data, kind):
    x, label, y = data
    target, reg = (label, 0.01) if kind == "softmax" else (y, 0.0)
    model = LN.fit(table(spark, x, target), kind, "features", "target", reg=reg, max_passes=120, tol=1e-6)
    value, g = gradient(x, target, model.weights, LN.LOSSES[kind], reg)
    assert np.abs(g).max() < 1e-4 and abs(value - model.losses[-1]) < 1e-9
    assert all(b <= a + 1e-12 for a, b in zip(model.losses, model.losses[1:]))
    dense, _ = LN.minimise(lambda w: gradient(x, target, w, LN.LOSSES[kind], reg), np.zeros_like(model.weights), 2000, 1e-10)
    assert abs(gradient(x, target, dense, LN.LOSSES[kind], reg)[0] - value) < 1e-7


def test_smooth_l1_bends_at_one():
    value, g = LN.smooth_l1(np.array([[0.5], [1.0], [3.0], [-4.0]]), np.zeros(4))
    assert value == 0.125 + 0.5 + 2.5 + 3.5 and g.ravel().tolist() == [0.5, 1.0, 1.0, -1.0]


def test_warm_start_from_a_stored_version_needs_fewer_passes(spark, data, tmp_path):
    x, label, _ = data
    df = table(spark, x, label)
    cold = TR.train_classifier(df.filter("doc_id % 10 > 0"), label_col="target", reg=0.01)
    LN.save(cold, spark, str(tmp_path / "models"), "v1")
    stored = LN.load(spark, str(tmp_path / "models"), "v1")
    assert np.array_equal(stored.weights, cold.weights) and stored.kind == "softmax" and LN.load(spark, str(tmp_path / "models"), "v2") is None
    fresh = TR.train_classifier(df, label_col="target", reg=0.01)
    warm = TR.train_classifier(df, label_col="target", reg=0.01, init=stored)
    assert abs(warm.losses[-1] - fresh.losses[-1]) < 1e-5 and len(warm.losses) < len(fresh.losses) and warm.losses[0] < fresh.losses[0]


def test_predictions_and_odd_rows(spark, data):
    x, label, y = data
    model = LN.fit(table(spark, x, label), "softmax", "features", "target", reg=0.1, max_passes=10)
    out = {r["doc_id"]: r for r in model.predict(table(spark, x, label)).collect()}
    z = x @ model.weights[:-1] + model.weights[-1]
    assert all(out[i]["prediction"] == z[i].argmax() and abs(sum(out[i]["probability"]) - 1) < 1e-9 for i in range(len(x)))
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (2, None, 0.0), (3, [0.0, 1.0], None)], "doc_id long, features array<double>, target double")
    fit = LN.fit(rows, "smooth_l1", "features", "target", max_passes=5)
    assert fit.weights.shape == (3, 1) and LN.fit(rows.limit(0), "smooth_l1", "features", "target").losses == []
    assert {r["doc_id"] for r in fit.predict(rows).collect()} == {1, 2, 3}
