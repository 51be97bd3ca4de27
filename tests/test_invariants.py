"""Invariants for the model-fit operators and cross-checks of the relational ones."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_global_index_matches_row_number(spark):
    from vellum.operators.ranking import global_index
    df = spark.range(0, 3000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id"))
    g = global_index(df, [F.col("k"), F.col("id")], "idx")
    w = df.withColumn("rn", F.row_number().over(Window.orderBy("k", "id")) - 1)
    j = g.join(w, ["k", "id"])
    assert j.filter("idx != rn").count() == 0 and g.count() == 3000


def test_fisher_closed_form_equals_recursion(spark):
    from vellum.operators.scoring import fisher_accumulate
    rng = np.random.default_rng(0)
    g = rng.normal(size=7)
    beta2 = 0.9
    fim = 1.0
    for t, gs in enumerate(g, start=1):
        cb = beta2 * (1 - beta2 ** (t - 1)) / (1 - beta2 ** t)
        fim = cb * fim + (1 - cb) * gs * gs
    df = spark.createDataFrame([(i, 0, "t", float(x)) for i, x in enumerate(g)], "batch long, class_no int, term string, g double")
    got = fisher_accumulate(df, len(g), beta2).first()["fim"]
    assert math.isclose(got, fim, rel_tol=1e-12)


def test_scores_are_distributions(spark):
    from vellum.plans.catalog import QUERIES
    p = QUERIES["score_probabilities"](spark, SF_SMALL)
    sums = p.groupBy("doc_id").agg(F.sum("prob").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-5).count() == 0


def test_mc_dropout_without_dropout_is_the_score(spark):
    from vellum.operators import scoring as SC
    from vellum.plans.model_fixture import K, lang_model
    m = lang_model(spark, SF_SMALL)
    mc = SC.mc_dropout(m.features, m.weights, m.bias, m.docs.select("doc_id"), K, n_samples=3, p=0.0)
    sc = SC.long_probs(SC.score_probabilities(m.features, m.weights, m.bias, m.docs.select("doc_id"), K))
    j = mc.join(sc, ["doc_id", "class_no"])
    assert j.filter((F.abs(F.col("mc_mean") - F.col("prob")) > 1e-9) | (F.col("mc_std") > 1e-9)).count() == 0


def test_full_retention_equals_unpruned_f1(spark):
    from vellum.plans.catalog import QUERIES
    curve = {r["fraction"]: r["weighted_f1"] for r in QUERIES["f1_retention_curve"](spark, SF_SMALL).collect()}
    base = QUERIES["classification_metrics"](spark, SF_SMALL).first()["weighted_f1"]
    assert curve[1.0] == base
    assert sorted(curve, reverse=True)[-1] == 0.0 and len(curve) == 11


def test_pca_centred_and_ordered(spark):
    from vellum.operators import models as MD
    e = MD.as_vector(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"), "embedding", "features")
    p = MD.pca_coordinates(e, "features", 3, "c").select(*[F.col("c")[i].alias(f"c{i}") for i in range(3)])
    stats = p.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(3)], *[F.var_pop(f"c{i}").alias(f"v{i}") for i in range(3)]).first()
    assert all(abs(stats[f"m{i}"]) < 1e-9 for i in range(3))
    assert stats["v0"] >= stats["v1"] >= stats["v2"]


def test_lda_matrix_rows_sum_to_one(spark):
    from vellum.plans.catalog import QUERIES
    m = QUERIES["lda_topic_matrix"](spark, SF_SMALL)
    s = m.select(F.aggregate("topic_mix", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert s.filter(F.abs(F.col("s") - 1) > 1e-6).count() == 0


def test_exact_silhouette_matches_numpy(spark):
    from vellum.operators import models as MD
    rng = np.random.default_rng(1)
    X = np.vstack([rng.normal(0, 1, (20, 3)), rng.normal(4, 1, (15, 3)), rng.normal(-4, 1, (1, 3))])
    lab = [0] * 20 + [1] * 15 + [2]
    df = spark.createDataFrame([(i, X[i].tolist(), lab[i]) for i in range(len(lab))], "vec_id long, embedding array<double>, label int")
    got = MD.silhouette(df, block_rows=8).first()["silhouette"]
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(len(lab)):
        same = [j for j in range(len(lab)) if lab[j] == lab[i] and j != i]
        if not same:
            s.append(0.0)
            continue
        a = D[i, same].mean()
        b = min(D[i, [j for j in range(len(lab)) if lab[j] == c]].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert math.isclose(got, float(np.mean(s)), rel_tol=1e-9)


def test_density_cluster_sizes(spark):
    from vellum.operators import models as MD
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    d = MD.density_clusters(e, "vec_id", "embedding", 3, 1.2, exact_block_rows=128)
    sizes = d.filter("cluster >= 0").groupBy("cluster").count().collect()
    assert all(r["count"] >= 3 for r in sizes)
    assert d.count() == e.count()


def test_ward_threshold_zero_keeps_micro_clusters(spark):
    from vellum.operators import models as MD
    e = MD.as_vector(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"), "embedding", "features")
    out = MD.hierarchical_clusters(e, threshold=0.0, micro_k=12, id_col="vec_id")
    assert out.select("cluster").distinct().count() == 12
    merged = MD.hierarchical_clusters(e, threshold=1e9, micro_k=12, id_col="vec_id")
    assert merged.select("cluster").distinct().count() == 1


def test_fisher_adam_zero_rate_and_decreasing_loss(spark):
    from vellum.operators import train as TR
    from vellum.plans.model_fixture import K, lang_model
    m = lang_model(spark, SF_SMALL)
    feats = m.features.select("doc_id", "term", "x")
    labels = m.docs.select("doc_id", "label")
    train = m.docs.filter("is_train").select("doc_id")
    _, states = TR.train_fisher_adam(feats, labels, m.vocab, K, train, None, TR.FisherAdam(rate=0.0), epochs=1, n_batches=2)
    assert states[-1].filter("value <> 0").isEmpty()
    log, states = TR.train_fisher_adam(feats, labels, m.vocab, K, train, train, epochs=3, n_batches=2)
    rows = log.orderBy("epoch").collect()
    assert rows[-1]["eval_loss"] <= rows[0]["eval_loss"]
    best = TR.best_epoch(log).first()
    assert best["eval_loss"] == min(r["eval_loss"] for r in rows)
    assert TR.best_state(log, states) is states[int(best["epoch"]) - 1]


def test_fisher_adam_step_matches_the_published_equations(spark):
    from vellum.operators import train as TR
    rng = np.random.default_rng(0)
    grads = {"weight": rng.normal(size=(3, 2, 5)), "bias": rng.normal(size=(3, 2, 1))}
    start = {p: rng.normal(size=g.shape[1:]) for p, g in grads.items()}
    cell = lambda p, x: [(p, k, f"t{j}" if p == "weight" else "", float(x[k, j])) for k in range(x.shape[0]) for j in range(x.shape[1])]
    s = TR.FisherAdam(rate=0.3, decay=0.05)
    schema = "param string, class_no int, term string"
    state = spark.createDataFrame([(*r, 0.0, 1.0) for p, x in start.items() for r in cell(p, x)], schema + ", value double, moment double, fisher double")
    for t in range(3):
        state = s.update(state, spark.createDataFrame([r for p, g in grads.items() for r in cell(p, g[t])], schema + ", g double"), t + 1)
    got = {(r["param"], r["class_no"], r["term"]): r["value"] for r in state.collect()}
    for p, theta in start.items():
        fim, mom = np.ones_like(theta), np.zeros_like(theta)
        for t in range(1, 4):
            g = grads[p][t - 1]
            b2 = 0.999 * (1 - 0.999 ** (t - 1)) / (1 - 0.999 ** t)
            fim = b2 * fim + (1 - b2) * g ** 2
            pre = fim ** 0.5 + 1e-8 * min(1, np.sqrt((g ** 2).mean()))
            clipped = lambda x: x / max(1, np.sqrt((x ** 2).mean()))
            mom = 0.9 * mom + 0.1 * clipped(g / pre)
            theta = theta - 0.3 * (mom + (0.05 * clipped(theta / pre) if p == "weight" else 0))
        for q, k, term, v in cell(p, theta):
            assert abs(got[(q, k, term)] - v) < 1e-9


def test_best_epoch_of_a_stored_log(spark):
    from vellum.operators import train as TR
    state = spark.createDataFrame([([(1.0, 5, 0.9), (2.0, 10, 0.4), (3.0, 15, 0.4), (4.0, 20, None)],)], "log_history array<struct<epoch:double,step:long,eval_loss:double>>")
    best = TR.best_epoch(TR.flatten_log_history(state)).first()
    assert (best["epoch"], best["step"]) == (2.0, 10)


def test_vocabulary_of_two_fits_agrees(spark):
    from vellum.operators import models as MD
    from vellum.operators import tokens as TK
    d = TK.with_tokens(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), "text")
    one, two = (MD.vocabulary_stats(x, "tokens", 0.02, 0.57) for x in (d, d.repartition(11)))
    assert one == two and len(one[0]) > 100


def test_density_components_that_do_not_settle_raise(spark):
    from vellum.operators import models as MD
    edges = spark.createDataFrame([(i, i + 1) for i in range(600)] + [(i + 1, i) for i in range(600)], "i long, j long")
    nodes = spark.range(601).withColumnRenamed("id", "node")
    with pytest.raises(RuntimeError):
        MD.connected_components(edges, nodes, max_rounds=2)


def test_score_dropout_averages_raw_scores(spark):
    from vellum.operators import scoring as SC
    feats = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0)], "doc_id long, term string, x double")
    w = spark.createDataFrame([("a", 2.0), ("b", -1.0)], "term string, w double")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    plain = {r["doc_id"]: r for r in SC.mc_dropout_columns(SC.mc_dropout_scores(feats, w, 10.0, docs, p=0.0), continuous=True).collect()}
    assert {i: (r["MC Continuous Mean"], r["MC Continuous Std"]) for i, r in plain.items()} == {1: (10.5, 0.0), 2: (12.0, 0.0), 3: (10.0, 0.0)}
    noisy = {r["doc_id"]: r for r in SC.mc_dropout_scores(feats, w, 10.0, docs, n_samples=50, p=0.5).collect()}
    assert noisy[2]["mc_std"] > 0 and abs(noisy[2]["mc_mean"] - 12.0) < 1.5 and noisy[3]["mc_std"] == 0


def test_prediction_columns_found_anywhere_in_the_name(spark):
    from vellum.operators.tables import prediction_columns
    names = ["doc_id", "Sentiment continuous: x", "probability distribution 2: pos", "other"]
    assert [p[1:] for p in prediction_columns(names)] == [("continuous", None, "x"), ("probability distribution", 2, "pos"), ("unknown", None, "other")]


def test_reduce_topics_reaches_target(spark):
    from vellum.operators import topics as TP
    cc = spark.createDataFrame([(t, f"w{(t * 3 + i) % 7}", 1 + (t + i) % 3) for t in range(-1, 6) for i in range(5)],
                               "topic int, term string, n long")
    sizes = spark.createDataFrame([(t, 10 + t) for t in range(-1, 6)], "topic int, size long")
    m = TP.reduce_topics(cc, 3, sizes=sizes)
    assert m.filter("new_topic >= 0").select("new_topic").distinct().count() == 3
    assert m.filter("topic = -1").first()["new_topic"] == -1


@pytest.mark.parametrize("name", ["kmeans_sweep", "topic_map", "train_classifier", "document_embeddings"])
def test_model_queries_run(spark, name):
    from vellum.plans.catalog import QUERIES
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_batch_embed_hook(spark):
    import numpy as np
    from vellum.operators.models import batch_embed
    df = spark.createDataFrame([(1, "ab"), (2, "abcd"), (3, None)], "doc_id long, Text string")
    enc = lambda texts: np.array([[len(t), 1.0] for t in texts])
    got = {r["doc_id"]: list(r["embedding"]) for r in batch_embed(df, "Text", enc, 2).collect()}
    assert got == {1: [2.0, 1.0], 2: [4.0, 1.0], 3: [0.0, 1.0]}


def test_small_helpers(spark):
    from vellum.operators import topics as TP
    from vellum.operators.textops import unmapped_labels
    from vellum.sources.documents import select_split
    words = spark.createDataFrame([(0, 1, "a", 0.5), (0, 2, "b", 0.2)], "topic int, rank int, word string, score double")
    assert TP.words_for_topic(words, 0) == [("a", 0.5), ("b", 0.2)]
    with pytest.raises(ValueError):
        TP.words_for_topic(words, 7)
    df = spark.createDataFrame([("x",), ("y",), (None,)], "lab string")
    assert unmapped_labels(df, "lab", {"x": 0}) == 1
    d = spark.range(0, 200).withColumnRenamed("id", "doc_id")
    assert select_split(d, "train").count() + select_split(d, "test").count() == 200


def test_lsh_pairs_are_a_subset_of_exact_pairs(spark):
    from vellum.operators import models as MD
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    exact = {(r["i"], r["j"]) for r in MD.neighbour_pairs(e, "vec_id", "embedding", 1.2, 128).collect()}
    approx = {(r["i"], r["j"]) for r in MD.neighbour_pairs(e, "vec_id", "embedding", 1.2, None,
                                                             bucket_length=2.0, num_tables=8).collect()}
    assert approx <= exact and len(exact) > 0
    d = MD.density_clusters(e, "vec_id", "embedding", 2, 1.2, exact_block_rows=None)
    assert d.count() == e.count()


def test_variance_by_group_default_names(spark):
    from vellum.operators import evaluate as EV
    var = spark.createDataFrame([("weight", 0, "a", 10.0), ("weight", 1, "a", 1000.0), ("bias", 0, "", 100.0), ("bias", 1, "", 0.0)],
                                "param string, class_no int, term string, variance double")
    rows = {(r["param"], r["class_no"]): r for r in EV.variance_by_group(var).collect()}
    assert rows[("bias", 0)]["class_name"] == "Bias_1" and rows[("bias", 1)]["class_name"] == "Bias_2"
    assert rows[("bias", 1)]["log10_floored"] == -15 and abs(rows[("weight", -1)]["log10_mean"] - np.log10(505)) < 1e-9
    assert EV.variance_by_group(var, ["neg", "pos"]).filter("class_no = 1").first()["class_name"] == "pos"


def test_finetune_results_without_uncertainty(spark):
    from vellum.operators import scoring as SC
    gold = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, gold_label int")
    scored = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.2, 0.8]), (3, [0.5, 0.5])], "doc_id long, probs array<double>")
    unc = spark.createDataFrame([(1, [0.01, 0.02])], "doc_id long, variance array<double>")
    rows = {r["doc_id"]: r for r in SC.finetune_results(gold, scored, unc).collect()}
    assert rows[1]["diamond_uncertainty"] == [0.01, 0.02] and rows[2]["diamond_uncertainty"] is None and len(rows) == 2
    assert all(r["diamond_uncertainty"] is None for r in SC.finetune_results(gold, scored).collect())


def test_training_table_samples_maps_and_encodes(spark):
    from vellum.operators import textops as TO
    df = spark.createDataFrame([(i, f"word{'ab'[i % 2]} text @user", "pos" if i % 2 else "neg") for i in range(20)], "doc_id long, t string, lab string")
    vocab = spark.createDataFrame([("text", 0)], "term string, token_id long")
    out = TO.prepare_training_table(df, {"text_field": "t", "label_field": "lab"}, {"neg": 0, "pos": 1}, vocab, n=8, max_len=4)
    rows = out.collect()
    assert len(rows) == 8 and out.columns == ["doc_id", "label", "split", "clean_text", "input_ids", "attention_mask"]
    assert all(r["label"] == r["doc_id"] % 2 and len(r["input_ids"]) == 4 and 1 in r["input_ids"] and "@" not in r["clean_text"] for r in rows)


def test_kmeans_tries_every_k_and_clusters_with_the_chosen_one(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    from vellum.plans import q_models
    rows = [(k, Vectors.sparse(14, [k % 14], [1.0 + (k // 14) / 100])) for k in range(28)]
    vectors = spark.createDataFrame(rows, ["doc_id", "features"]).coalesce(1).persist()
    monkeypatch.setattr(q_models, "_tfidf_vectors", lambda *_: vectors)
    sweep = {r["k"]: r for r in q_models.q_kmeans_sweep(spark, "").collect()}
    assert sorted(sweep) == list(range(2, 28))
    chosen = [k for k, r in sweep.items() if r["chosen"]]
    assert len(chosen) == 1 and chosen[0] > 10
    assert q_models.q_kmeans(spark, "").select("Kcluster_topic").distinct().count() == chosen[0]


def test_topic_reduction_matches_a_plain_one(spark):
    from vellum.operators import topics as TP
    rng = np.random.default_rng(12)
    terms = [f"w{i}" for i in range(30)]
    counts = {(t, w): int(rng.integers(1, 9)) for t in range(-1, 9) for w in rng.choice(terms, 12, replace=False)}
    size = {t: 20 + (t * 7) % 5 for t in range(-1, 9)}
    into = {t: t for t in size}
    live = {t: n for t, n in size.items() if t >= 0}
    while len(live) > 3:
        n = {}
        for (t, w), c in counts.items():
            n[(into[t], w)] = n.get((into[t], w), 0) + c
        f = {w: sum(c for (_, x), c in n.items() if x == w) for w in terms}
        mean = sum(n.values()) // len({t for t, _ in n})
        vec = {t: np.array([n.get((t, w), 0) * math.log(1 + mean / f[w]) if f[w] else 0.0 for w in terms]) for t in live}
        s = min(live, key=lambda t: (live[t], t))
        cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
        best = min((t for t in live if t != s), key=lambda t: (-cos(vec[s], vec[t]), t))
        live[best] += live.pop(s)
        into = {t: best if m == s else m for t, m in into.items()}
    order = {t: i for i, t in enumerate(sorted(live, key=lambda t: (-live[t], t)))}
    cc = spark.createDataFrame([(t, w, c) for (t, w), c in counts.items()], "topic int, term string, n long")
    sizes = spark.createDataFrame(list(size.items()), "topic int, size long")
    got = {r["topic"]: r["new_topic"] for r in TP.reduce_topics(cc, 3, sizes=sizes).collect()}
    assert got == {t: order.get(m, -1) for t, m in into.items()}
