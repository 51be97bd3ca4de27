import numpy as np
import pytest

from vellum.llm import hard_negatives

SCHEMA = "vec_id long, label int, vector array<long>"


def brute(rows, anchors, n_pos=5, n_neg=3, low=50, high=95):
    once = {}
    for i, lab, v in rows:
        if i is not None and lab is not None and v is not None and (i not in once or (lab, v) < once[i]):
            once[i] = (lab, v)
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in sorted({a for a in anchors if a in once}):
        lab, q = once[a]
        scored = sorted(((-dot(q, v), i, l2) for i, (l2, v) in once.items() if i != a))
        for s, i, _ in [t for t in scored if t[2] == lab][:n_pos]:
            fit = [t for t in scored if t[2] != lab and low * -s <= 100 * -t[0] <= high * -s]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fit[:n_neg])]
    return sorted(out)


def mined(spark, rows, anchors, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine(df, df.filter(df["vec_id"].isin([*anchors])), **kw).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 90)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 11)
    rng = np.random.default_rng(seed)
    centre = rng.integers(-60, 60, (4, 24))
    rows = [(i, int(i % 4 if seed == 1 else min(i % 9, 3)), (centre[i % 4] + rng.integers(-40, 40, 24)).tolist()) for i in range(400)]
    anchors = range(0, 400, 13)
    assert mined(spark, rows, anchors) == brute(rows, anchors)
    assert mined(spark, rows, anchors, n_positives=2, n_negatives=7, low=10, high=100) == brute(rows, anchors, 2, 7, 10, 100)


def test_odd_rows(spark):
    v = [3, -1, 2]
    rows = [(i, 0, v) for i in range(50)] + [(100 + i, 1, [2, -1, 1]) for i in range(50)]  # two groups of copies: ties to the smaller id
    rows += [(0, 0, v), (5, 0, [1, 1, 1]), (5, 0, [1, 1])]  # repeated rows and ids
    rows += [(None, 0, v), (201, None, v), (202, 0, None), (203, 1, []), (204, 2, [1]), (205, 1, [1 << 40, 5, 1 << 41]), (206, 0, [1 << 20, 0, 1])]
    assert mined(spark, rows, [0, 5, 102, 201, 203, 204, 206]) == brute(rows, [0, 5, 102, 203, 204, 206])
    assert mined(spark, [], [0]) == []
    extra = spark.createDataFrame([(1, 0, [1], "x")], SCHEMA + ", block string")
    assert hard_negatives.mine(extra, extra).count() == 0


def test_pruning_reads_fewer_rows_and_loses_none():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (3000, 32)) * np.array([8] * 4 + [1] * 28)
    label = np.sort(rng.integers(0, 3, 3000))
    b = hard_negatives.Block(np.arange(3000).tobytes(), label.tobytes(), np.ascontiguousarray(x.T).astype("<i8").tobytes(), False)
    q, read = x[7], []
    scan = b.scan
    b.scan = lambda q, rows, keep: scan(q, rows, lambda lo, up: read.append(len(lo)) or keep(lo, up))
    ids, score = hard_negatives.positives_of(b, 7, int(label[7]), q, 5)
    same = np.flatnonzero((label == label[7]) & (np.arange(3000) != 7))
    full = x[same] @ q
    best = np.lexsort((same, -full))[:5]
    assert ids.tolist() == same[best].tolist() and score.tolist() == full[best].tolist()
    assert read[-1] < read[0] / 10
