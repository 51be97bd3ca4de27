"""Density clusters by pivots and silhouettes by the centroid bound, against all pairs."""

import numpy as np
import pytest

from vellum.operators import models as MD
from vellum.operators import neighbours as NB


def brute_density(ids, x, min_size, eps):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min_size - 1] if len(x) >= min_size else np.full(len(x), np.inf)
    edge = np.maximum(d, np.maximum(core[:, None], core[None])) <= eps
    label = np.arange(len(x))
    while True:
        new = np.array([label[edge[i] | (np.arange(len(x)) == i)].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    low = {c: min(ids[label == c]) for c in set(label.tolist())}
    order = sorted((-(label == c).sum(), low[c], c) for c in low if (label == c).sum() >= min_size)
    rank = {c: i for i, (_, _, c) in enumerate(order)}
    return {int(i): rank.get(c, -1) for i, c in zip(ids, label, strict=True)}


@pytest.mark.parametrize(("min_size", "eps"), [(2, 0.6), (4, 0.9), (1, 0.5)])
def test_density_clusters_match_all_pairs(spark, min_size, eps):
    rng = np.random.default_rng(min_size)
    x = np.concatenate([rng.normal(c, 0.35, (40, 3)) for c in (0, 4, 8)] + [rng.uniform(-3, 11, (30, 3)), np.full((60, 3), 4.0), np.full((3, 3), 20.0)])
    ids = rng.permutation(len(x)) + 100
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, cell string").repartition(5)
    got = {r["vec_id"]: r["cluster"] for r in MD.density_clusters(df, "vec_id", "embedding", min_size, eps, exact_block_rows=16).collect()}
    assert got == brute_density(ids, x, min_size, eps)
    assert MD.density_clusters(df.limit(0), "vec_id", "embedding", min_size, eps).count() == 0


def test_cells_bound_tasks_and_save_comparisons(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (100, 2)) for c in (0, 10, 20, 30)] + [np.full((300, 2), 5.0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    reps, copies = NB.distinct_points(NB.points_of(df, "vec_id", "embedding"))
    assert reps.count() == 401 and copies.count() == 700 and reps.filter("copies = 300").count() == 1
    cells = NB.Cells(reps, 0.5, block_rows=32)
    assert cells.compared < 0.5 * 401 ** 2
    seen = cells.compare(lambda a, b: __import__("pyarrow").table({"n": [max(a.num_rows, b.num_rows)]}), "n long").agg({"n": "max"}).first()[0]
    assert seen <= 64  # blocks of 32, dealt by hash


def test_silhouette_matches_all_pairs_with_fewer_comparisons(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 1.0, (25, 2)) for c in ((0, 0), (9, 0), (0, 9), (9, 9), (30, 30), (4, 4))] + [[[50.0, 50.0]]])
    label = np.append(np.repeat(np.arange(6), 25), 6)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int").repartition(3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        b = min(d[i, label == c].mean() for c in range(7) if c != label[i])
        want.append((b - d[i, own].mean()) / max(b, d[i, own].mean()) if own.any() else 0.0)
    per = {r["pid"]: r["s"] for r in MD.silhouette(df, block_rows=10, per_point=True).collect()}
    assert np.allclose([per[i] for i in range(len(x))], want)
    row = MD.silhouette(df, with_share=True).first()
    assert abs(row["silhouette"] - np.mean(want)) < 1e-9 and row["n"] == len(x) and row["compared"] < 0.5
    one = MD.silhouette(df.filter("label = 0")).first()
    assert one["silhouette"] == 0.0 and one["n"] == 25


def test_copies_sent_do_not_grow_with_the_table(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(800, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    made, compare = [], NB.Cells.compare
    monkeypatch.setattr(NB.Cells, "compare", lambda self, *a: made.append(self) or compare(self, *a))
    assert MD.density_clusters(df, "vec_id", "embedding", 2, 1.15, exact_block_rows=16).count() == 800
    assert made[0].table.selectExpr("max(size(cells))").first()[0] <= 16  # the triangle inequality excludes no cell here


def test_strips_and_ties():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(3000, 3)), rng.normal(size=(900, 3))
    parts = list(NB.strips(a, b))
    assert len(parts) > 1 and np.allclose(np.concatenate([d for _, d in parts]), NB.distances(a, b))
    label = NB.tie(np.arange(7), np.array([6, 5, 2]), np.array([5, 4, 2]))
    assert NB.tie(label, np.array([6]), np.array([1])).tolist() == [0, 1, 2, 3, 1, 1, 1]
