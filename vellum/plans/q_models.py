"""Registered model queries: MLlib fits and geometry (rows/invariant checks), plus exact
silhouette, density clusters and lemmatising (SQL oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import centres as CE
from vellum.operators import lda as LD
from vellum.operators import models as MD
from vellum.operators import rows as R
from vellum.operators import textops as TO
from vellum.operators import tokens as TK
from vellum.operators import topics as TP
from vellum.operators import train as TR
from vellum.plans import sqlgen as S
from vellum.plans.inputs import table
from vellum.plans.model_fixture import K, LANGS, lang_model
from vellum.plans.registry import register
from vellum.sources import documents as SD


def _doc_tokens(spark, sf_dir, extra=True):
    return TK.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "text", extra=extra)


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


# ---------------------------------------------------------------- exact / SQL-checked geometry
_EMB_SQL = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pd AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, list_distance(a.v, b.v) AS d
       FROM e a JOIN e b ON a.vec_id <> b.vec_id)"""


@register("silhouette", "WITH " + _EMB_SQL + """,
pm AS (SELECT i, lj, any_value(li) AS li, avg(d) AS md FROM pd GROUP BY i, lj),
ab AS (SELECT i, max(CASE WHEN lj = li THEN md END) AS a, min(CASE WHEN lj <> li THEN md END) AS b FROM pm GROUP BY i),
s AS (SELECT e.vec_id, CASE WHEN ab.a IS NULL OR ab.b IS NULL THEN 0 ELSE (ab.b - ab.a) / greatest(ab.a, ab.b) END AS s
      FROM e LEFT JOIN ab ON ab.i = e.vec_id)
SELECT round(avg(s), 6) AS silhouette, count(*) AS n FROM s""")
def q_silhouette(spark, sf_dir):
    s = MD.silhouette(_emb(spark, sf_dir), "vec_id", "embedding", "label")
    return s.select(F.round("silhouette", 6).alias("silhouette"), "n")


DENSITY_EPS, DENSITY_MIN = 1.15, 2


@register("density_clusters", "WITH RECURSIVE " + _EMB_SQL + f""",
np_ AS (SELECT i, j, d FROM pd WHERE d <= {DENSITY_EPS}),
core AS (SELECT i, d AS core FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM np_)
         WHERE r = {DENSITY_MIN - 1}),
edges AS (SELECT np_.i, np_.j FROM np_ JOIN core ci ON ci.i = np_.i JOIN core cj ON cj.i = np_.j
          WHERE greatest(ci.core, cj.core, np_.d) <= {DENSITY_EPS}),
reach(src, dst) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.src, edges.j FROM reach r JOIN edges ON edges.i = r.dst),
comp AS (SELECT src AS node, min(dst) AS comp FROM reach GROUP BY src),
sizes AS (SELECT comp, count(*) AS size FROM comp GROUP BY comp HAVING count(*) >= {DENSITY_MIN}),
rk AS (SELECT comp, row_number() OVER (ORDER BY size DESC, comp) - 1 AS cluster FROM sizes)
SELECT node AS vec_id, CAST(coalesce(rk.cluster, -1) AS INTEGER) AS cluster FROM comp LEFT JOIN rk USING (comp)""")
def q_density(spark, sf_dir):
    return MD.density_clusters(_emb(spark, sf_dir), "vec_id", "embedding", DENSITY_MIN, DENSITY_EPS, exact_block_rows=256)


_LEMMA_CASES = ", ".join(
    f"CASE WHEN suffix(token, '{suf}') AND length(token) > {len(suf)} THEN substr(token, 1, length(token) - {len(suf)}) || '{rep}' END"
    for suf, rep in TO.NOUN_SUFFIX_RULES)


@register("lemmatise_tokens", f"""
WITH tk AS (SELECT DISTINCT unnest({S.filtered_tokens('text')}) AS token FROM documents),
cand AS (SELECT token, unnest([token, {_LEMMA_CASES}]) AS c FROM tk),
valid AS (SELECT token, c FROM cand WHERE c IS NOT NULL AND c IN (SELECT token FROM tk)),
best AS (SELECT token, first(c ORDER BY length(c), c) AS lemma FROM valid GROUP BY token)
SELECT tk.token, coalesce(best.lemma, tk.token) AS lemma FROM tk LEFT JOIN best USING (token)""")
def q_lemma(spark, sf_dir):
    d = TK.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    toks = TK.explode_values(d, [], F.col("tokens"), "token")
    vocab = toks.select(F.col("token").alias("term")).distinct()
    return TO.lemmatise(toks, vocab)


# ---------------------------------------------------------------- MLlib fits (rows / invariants)
@register("document_embeddings")
def q_doc_emb(spark, sf_dir):
    d = _doc_tokens(spark, sf_dir)
    return MD.document_embeddings(d, "indexing", "tokens", dim=16).select("doc_id", "embedding")


@register("reduce_embeddings")
def q_reduce_emb(spark, sf_dir):
    e = MD.as_vector(_emb(spark, sf_dir), "embedding", "features")
    r = MD.reduce_embeddings(e, "features", 5, id_col="vec_id")
    return r.select("vec_id", "reduced")


def _lda_counts(spark, sf_dir):
    # Documents, their number and their blocks are read from the written tokens.
    d, _ = R.store(_doc_tokens(spark, sf_dir).select("doc_id", "tokens"), "tokens")
    counts = TK.term_counts(d, F.col("tokens"), ("doc_id",))
    return d.select("doc_id"), LD.B.write_blocks(counts)


@register("lda_fit")
def q_lda(spark, sf_dir):
    """The ten likeliest terms of each of ten topics."""
    _, blocks = _lda_counts(spark, sf_dir)
    model = LD.fit(blocks.counts, k=10, seed=42, passes=10, blocks=blocks)
    blocks.drop()
    return LD.describe(model, 10)


def _lda_matrix(spark, sf_dir, k=10):
    docs, blocks = _lda_counts(spark, sf_dir)
    coded = LD.B.code(blocks)
    model = LD.fit(blocks.counts, k=k, seed=42, passes=10, blocks=blocks, coded=coded)
    return LD.topic_matrix(model, blocks.counts, docs, blocks=blocks, coded=coded)


@register("lda_topic_matrix")
def q_lda_matrix(spark, sf_dir):
    m = _lda_matrix(spark, sf_dir)
    return m.select("doc_id", "topic_mix", MD.dominant_topic("topic_mix").alias("LDA_Topics"))


@register("pca_topic_mixture")
def q_pca_lda(spark, sf_dir):
    p = MD.pca_coordinates(_lda_matrix(spark, sf_dir), "topic_mix", 3, "coords", id_col="doc_id")
    from vellum.functions.text import encode_coords
    return p.select("doc_id", "coords", encode_coords("coords").alias("LDA_PCA_Coordinates"))


def _tfidf_vectors(spark, sf_dir):
    # Counting, vectorising and every fit above read the written tokens: a text is tokenised once.
    d, _ = R.store(_doc_tokens(spark, sf_dir).drop("text"), "tokens")
    d = d.withColumn("terms", TK.ngrams("tokens", 1, 2))
    return MD.tfidf_vectors(d, "terms", min_df=0.02, max_df=0.57)


@register("pca_tfidf")
def q_pca_tfidf(spark, sf_dir):
    t = _tfidf_vectors(spark, sf_dir)
    p = MD.pca_coordinates(t, "features", 3, "coords", id_col="doc_id")
    from vellum.functions.text import encode_coords
    return p.select("doc_id", "coords", encode_coords("coords").alias("Kcluster_PCA"))


@register("kmeans_cluster")
def q_kmeans(spark, sf_dir):
    return CE.cluster(_tfidf_vectors(spark, sf_dir)).select("doc_id", F.col("cluster").alias("Kcluster_topic"))


@register("kmeans_sweep")
def q_kmeans_sweep(spark, sf_dir):
    return CE.sweep(_tfidf_vectors(spark, sf_dir))


@register("hierarchical_clusters")
def q_ward(spark, sf_dir):
    e = MD.as_vector(_emb(spark, sf_dir), "embedding", "features")
    return MD.hierarchical_clusters(e, "features", threshold=0.5, micro_k=100, id_col="vec_id")


@register("silhouette_series_1d")
def q_sil_1d(spark, sf_dir):
    from vellum.plans.q_model import _scored
    m, sc = _scored(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    v = MD.as_vector(sc.filter(F.forall("probs", lambda p: p.isNotNull())), "probs", "features")
    p = MD.pca_coordinates(v, "features", 1, "c", normalise=True, id_col="doc_id")
    return (p.join(m.docs.select("doc_id", "source"), "doc_id").join(ev, "doc_id", "left")
             .select("doc_id", "source", "ts", F.col("c")[0].alias("value")))


@register("topic_map")
def q_topic_map(spark, sf_dir):
    from vellum.plans.q_topics import _assigned, _topic_ct
    ct = _topic_ct(spark, sf_dir)
    sizes = TP.topic_sizes(_assigned(spark, sf_dir))
    return TP.topic_map(ct, sizes, TP.top_words(ct, 10))


@register("reduce_topics")
def q_reduce_topics(spark, sf_dir):
    from vellum.plans.q_topics import _assigned, _topic_docs
    cc = TP.class_term_counts(_topic_docs(spark, sf_dir), "tokens")
    return TP.reduce_topics(cc, 10, sizes=TP.topic_sizes(_assigned(spark, sf_dir)))


# ---------------------------------------------------------------- training
@register("train_classifier")
def q_train_clf(spark, sf_dir):
    """Fit on the training split, predict the other."""
    t = _tfidf_vectors(spark, sf_dir)
    lab = SD.split_documents(TO.map_labels(t, "lang", {lang: i for i, lang in enumerate(LANGS)}))
    model = TR.train_classifier(lab.filter("split = 'train'"), "features", "label", max_passes=30)
    out = model.predict(lab.filter("split = 'test'"))
    return out.select("doc_id", "label", F.col("prediction").cast("int").alias("pred"), F.col("probability").alias("probs"))


@register("train_regressor")
def q_train_reg(spark, sf_dir):
    """Fit on the training split, predict the other."""
    t = _tfidf_vectors(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("value").alias("y"))
    df = SD.split_documents(t.join(ev, "doc_id"))
    model = TR.train_regressor(df.filter("split = 'train'"), "features", "y", max_passes=30)
    return model.predict(df.filter("split = 'test'")).select("doc_id", "y", "prediction")


def _fadam(spark, sf_dir):
    m = lang_model(spark, sf_dir)
    feats = m.packed.select("doc_id", "term", "x")
    return TR.train_fisher_adam(feats, m.docs.select("doc_id", "label"), m.vocab, K, m.docs.filter("is_train").select("doc_id"),
                                m.docs.filter(~F.col("is_train")).select("doc_id"), epochs=3, n_batches=4)


@register("train_fisher_adam")
def q_fadam(spark, sf_dir):
    return _fadam(spark, sf_dir)[0]


@register("best_epoch")
def q_best_epoch(spark, sf_dir):
    """Size of the best epoch's model, with its epoch and eval loss."""
    log, states = _fadam(spark, sf_dir)
    w, _ = TR.model_tables(TR.best_state(log, states))
    return TR.best_epoch(log).crossJoin(w.agg(F.count(F.lit(1)).alias("n_weights"), F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("norm")))
