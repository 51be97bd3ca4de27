"""Fits over term-partitioned tables: topic model and random indexing, against dense computations."""

import math

import numpy as np
import pytest

from vellum.operators import indexing as RI
from vellum.operators import lda as LD
from vellum.operators import term_blocks as B


def test_special_functions():
    x = np.array([0.01, 0.1, 0.5, 1.0, 2.5, 7.0, 100.0])
    assert np.allclose(LD.log_gamma(x), [math.lgamma(v) for v in x], atol=1e-9)
    step = 1e-6
    assert np.allclose(LD.digamma(x[1:]), [(math.lgamma(v + step) - math.lgamma(v - step)) / (2 * step) for v in x[1:]], atol=1e-5)
    assert abs(LD.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-10


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        subject = i % 3
        for t in rng.choice(15, size=rng.integers(4, 10), replace=False):
            word = f"s{subject}w{t}" if rng.random() < 0.9 else f"s{(subject + 1) % 3}w{t}"
            rows.append((i, word, int(rng.integers(1, 5))))
    return sorted({(d, t): n for d, t, n in rows}.items())


def table(spark, corpus):
    return spark.createDataFrame([(d, t, n) for (d, t), n in corpus], "doc_id long, term string, n long")


def dense(corpus, start, k, passes, alpha, eta):
    """The same updates on one machine: lists of terms and documents, no tables."""
    terms = sorted({t for (_, t), _ in corpus})
    docs = sorted({d for (d, _), _ in corpus})
    d = np.array([docs.index(a) for (a, _), _ in corpus])
    t = np.array([terms.index(a) for (_, a), _ in corpus])
    n = np.array([c for _, c in corpus], float)
    lam = np.array([start[x] for x in terms])
    for _ in range(passes):
        _, stats, _ = LD.mixtures(d, t, n, len(docs), np.exp(LD.digamma(lam) - LD.digamma(lam.sum(0))), alpha)
        lam = stats + eta
    gamma, _, _ = LD.mixtures(d, t, n, len(docs), np.exp(LD.digamma(lam) - LD.digamma(lam.sum(0))), alpha)
    return dict(zip(terms, lam, strict=True)), dict(zip(docs, gamma / gamma.sum(1)[:, None], strict=True))


def test_topic_model_matches_a_dense_run_and_its_bound_rises(spark, corpus):
    counts = table(spark, corpus)
    blocks = B.write_blocks(counts, block_docs=16)
    start = {r["term"]: r["lam"] for r in LD._start(blocks.needs, 3, 42).collect()}
    model = LD.fit(counts, k=3, passes=8, blocks=blocks)
    lam, mix = dense(corpus, start, 3, 8, 1 / 3, 1 / 3)
    got = {r["term"]: r["lam"] for r in model.table.collect()}
    assert set(got) == set(lam) and all(np.allclose(got[x], lam[x], atol=1e-5) for x in lam)
    assert len(model.bounds) == 8 and all(b >= a - 1e-6 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))
    docs = spark.range(62).withColumnRenamed("id", "doc_id")
    found = {r["doc_id"]: r["topic_mix"] for r in LD.topic_matrix(model, counts, docs).collect()}
    assert all(np.allclose(found[i], mix[i], atol=1e-5) for i in mix) and found[60] == found[61] == [1 / 3] * 3
    best = np.array([np.argmax(found[i]) for i in range(60)])
    assert all(np.bincount(best[s::3]).max() >= 18 for s in range(3)) and len({np.bincount(best[s::3]).argmax() for s in range(3)}) == 3
    words = LD.describe(model, 4).collect()
    assert len(words) == 12 and all(len({r["term"][:2] for r in words if r["topic"] == k}) == 1 for k in range(3))


def test_topic_model_of_no_rows_and_repeated_runs(spark, corpus):
    empty = table(spark, corpus).limit(0)
    model = LD.fit(empty, k=2, passes=3)
    assert LD.describe(model).count() == 0 and model.bounds == []
    docs = spark.range(2).withColumnRenamed("id", "doc_id")
    assert [r["topic_mix"] for r in LD.topic_matrix(model, empty, docs).collect()] == [[0.5, 0.5]] * 2
    a, b = (sorted((r["term"], tuple(r["lam"])) for r in LD.fit(table(spark, corpus).repartition(p), k=2, passes=2).table.collect()) for p in (2, 7))
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b])


def test_context_vectors_are_neighbour_sums(spark):
    texts = [["a", "b", "c", "a"], ["b", "b"], [], None, ["c", None, "a"], ["d"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, tokens array<string>").repartition(3)
    got = {r["term"]: r["vector"] for r in RI.context_vectors(df, dim=12, window=2).collect()}
    terms = ["a", "b", "c", "d"]
    index = dict(zip(terms, RI.index_vectors(terms, 12, 42), strict=True))
    want = {t: np.zeros(12, int) for t in terms}
    for t in texts:
        t = [x for x in t or [] if x is not None]
        for i, x in enumerate(t):
            for j in range(max(0, i - 2), min(len(t), i + 3)):
                if j != i:
                    want[x] = want[x] + index[t[j]]
    assert set(got) == set(terms) and all(list(want[t]) == got[t] for t in terms)
    vec = {r["doc_id"]: r["embedding"] for r in RI.embed(df, dim=12).collect()}
    assert len(vec) == 6 and vec[2] == vec[3] == vec[5] == [0.0] * 12 and abs(np.linalg.norm(vec[0]) - 1) < 1e-9
    assert RI.embed(df.limit(0), dim=12).count() == 0


def test_neighbours_agree_with_the_full_cooccurrence_table(spark):
    rng = np.random.default_rng(2)
    subject = [[f"s{s}w{i}" for i in range(12)] for s in range(4)]
    texts = [[str(rng.choice(subject[k % 4])) for _ in range(30)] for k in range(48)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens array<string>").repartition(4)
    terms = sorted({w for t in texts for w in t})
    full = np.zeros((len(terms), len(terms)))
    at = {t: i for i, t in enumerate(terms)}
    for t in texts:
        for i, x in enumerate(t):
            for y in t[max(0, i - 2):i] + t[i + 1:i + 3]:
                full[at[x], at[y]] += 1
    exact = full / np.linalg.norm(full, axis=1)[:, None]
    got = {r["term"]: np.array(r["vector"], float) for r in RI.context_vectors(df, dim=400).collect()}
    near = np.array([got[t] / np.linalg.norm(got[t]) for t in terms])
    assert np.abs(exact @ exact.T - near @ near.T).mean() < 0.08
    vec = {r["doc_id"]: np.array(r["embedding"]) for r in RI.embed(df, dim=64).collect()}
    again = {r["doc_id"]: np.array(r["embedding"]) for r in RI.embed(df.repartition(2), dim=64).collect()}
    v = np.array([vec[i] for i in range(48)])
    assert np.allclose(v, [again[i] for i in range(48)])
    sim = v @ v.T - 2 * np.eye(48)
    assert all(i % 4 == j % 4 for i, j in enumerate(sim.argmax(1)))


def test_settled_documents_leave_the_updates(monkeypatch):
    rng = np.random.default_rng(8)
    topic_word = rng.dirichlet(np.full(40, 0.1), 3).T + 1e-6
    size = np.append(np.full(50, 1), 30)
    doc = np.repeat(np.arange(51), size)
    term, n = rng.integers(0, 40, len(doc)), np.ones(len(doc))
    rows, exact = [], LD.digamma
    monkeypatch.setattr(LD, "digamma", lambda x: rows.append(len(x)) or exact(x))
    gamma, _, _ = LD.mixtures(doc, term, n, 51, topic_word, 0.1)
    assert rows[0] == 51 and min(rows) < 51
    one, _, _ = LD.mixtures(np.zeros(30, np.int64), term[-30:], n[-30:], 1, topic_word, 0.1)
    assert np.allclose(gamma[50], one[0], atol=1e-12)


def test_tokens_of_embeddings_are_made_once(spark):
    """Counts, documents and neighbourhoods read a written table; rows that repeat an id count their terms once."""
    from pyspark.sql import functions as F
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(text):
        made.add(1)
        return text.split()

    texts = [(0, "a b c a"), (1, "b c"), (2, "a d"), (2, "d a a"), (3, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("tokens", split("text"))
    got = RI.embed(df, dim=8).select("doc_id", "embedding").collect()
    assert made.value == len(texts) and len(got) == len(texts)
    whole = spark.createDataFrame([(0, "a b c a".split()), (1, ["b", "c"])], "doc_id long, tokens array<string>")
    rows = whole.selectExpr("doc_id", "array_distinct(tokens) AS term", "transform(array_distinct(tokens), x -> 1L) AS n")
    for packed, want in ((rows, {"a": 1, "b": 2, "c": 2}), (rows.unionAll(rows), {"a": 1, "b": 2, "c": 2})):
        blocks = B.write_packed(packed)
        assert blocks.n_docs == 2 and {r["term"]: r["docs"] for r in blocks.needs.collect()} == want


def test_passes_shuffle_the_topics_only(spark, corpus):
    """A pass's join and its blocks read what was dealt once; mixtures do not depend on the documents beside them."""
    blocks = B.write_blocks(table(spark, corpus), block_docs=16)
    coded = B.code(blocks)
    topics = LD._start(blocks.needs, 3, 42).localCheckpoint()
    plan = coded.meet(topics, lambda a, b: b, "term string")._jdf.queryExecution().executedPlan().toString()
    top = plan.split("InMemoryRelation")[0]
    assert top.count("Exchange hash") <= 2 and "Exchange hashpartitioning(block" not in top
    coded.drop()
    rng = np.random.default_rng(5)
    size = rng.integers(0, 90, 40)
    doc, topic_word = np.repeat(np.arange(40), size), rng.dirichlet(np.full(60, 0.2), 4).T + 1e-6
    term, n, mix = rng.integers(0, 60, len(doc)), rng.integers(1, 5, len(doc)).astype(float), rng.permutation(len(doc))
    gamma, stats, bound = LD.mixtures(doc, term, n, 40, topic_word, 0.3)
    again = LD.mixtures(doc[mix], term[mix], n[mix], 40, topic_word, 0.3)
    assert np.allclose(gamma, again[0]) and np.allclose(stats, again[1]) and np.isclose(bound, again[2])
    for i in range(40):
        own = doc == i
        one, _, _ = LD.mixtures(np.zeros(own.sum(), np.int64), term[own], n[own], 1, topic_word, 0.3)
        assert np.allclose(gamma[i], one[0], atol=1e-9)
