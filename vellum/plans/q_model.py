"""Registered scoring, uncertainty and evaluation queries over the checked model."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import evaluate as EV
from vellum.operators import scoring as SC
from vellum.operators.common import key_hash, reuse
from vellum.operators.ranking import global_index
from vellum.plans import sqlgen as S
from vellum.plans.model_fixture import BATCH, BETA2, K, LANGS, lang_model, model_ctes
from vellum.plans.registry import register

W = "WITH " + model_ctes()


def _scored(spark, sf_dir):
    m = lang_model(spark, sf_dir)
    return m, SC.score_probabilities(m.coded, m.coded_weights, m.bias, m.docs.select("doc_id"), K)


def _preds(spark, sf_dir):
    m, sc = _scored(spark, sf_dir)
    return m, sc.select("doc_id", "probs", "logits", SC.argmax(F.col("probs")).alias("pred"))


def _classes_df(spark):
    return spark.createDataFrame([(i, lang) for i, lang in enumerate(LANGS)], "class_no int, class_name string")


@register("score_probabilities", W + """
SELECT doc_id, class_no, round(z, 6) AS logit, round(p, 6) AS prob FROM prob""")
def q_score(spark, sf_dir):
    _, sc = _scored(spark, sf_dir)
    return SC.long_probs(sc).select("doc_id", "class_no", F.round("logit", 6).alias("logit"),
                                    F.round("prob", 6).alias("prob"))


@register("predicted_class", W + "\nSELECT doc_id, pred FROM pred")
def q_pred(spark, sf_dir):
    _, p = _preds(spark, sf_dir)
    return p.select("doc_id", "pred")


_METRICS_SQL = """
{p}conf AS (SELECT {keys}label, pred, count(*) AS c FROM {src} GROUP BY ALL),
{p}sup AS (SELECT {keys}label AS cls, sum(c) AS support FROM {p}conf GROUP BY ALL),
{p}np AS (SELECT {keys}pred AS cls, sum(c) AS npred FROM {p}conf GROUP BY ALL),
{p}tp AS (SELECT {keys}label AS cls, c AS tp FROM {p}conf WHERE label = pred),
{p}per AS (SELECT {skeys}{p}sup.cls, support, coalesce(npred, 0) AS npred, coalesce(tp, 0) AS tp,
               coalesce(2.0 * coalesce(tp, 0) / nullif(coalesce(npred, 0) + support, 0), 0) AS f1
        FROM {p}sup LEFT JOIN {p}np USING ({ukeys}cls) LEFT JOIN {p}tp USING ({ukeys}cls)),
{p}met AS (SELECT {keys}sum(tp) / sum(support) AS accuracy, sum(support * f1) / sum(support) AS weighted_f1,
               CAST(sum(support) AS BIGINT) AS n FROM {p}per {group})"""


def metrics_sql(src: str, keys: list[str] = (), prefix: str = "") -> str:
    k = "".join(f"{x}, " for x in keys)
    sk = "".join(f"{prefix}sup.{x}, " for x in keys)
    return _METRICS_SQL.format(keys=k, skeys=sk, ukeys=k, src=src, p=prefix,
                               group=("GROUP BY " + ", ".join(keys)) if keys else "")


@register("classification_metrics", W + "," + metrics_sql("test") + """
SELECT round(accuracy, 6) AS accuracy, round(weighted_f1, 6) AS weighted_f1, n FROM met""")
def q_metrics(spark, sf_dir):
    m, p = _preds(spark, sf_dir)
    pairs = p.join(m.docs.filter(~F.col("is_train")).select("doc_id", "label"), "doc_id")
    r = EV.weighted_f1(pairs)
    return r.select(F.round("accuracy", 6).alias("accuracy"), F.round("weighted_f1", 6).alias("weighted_f1"), "n")


@register("class_histogram", W + """,
h AS (SELECT pred AS class_no, count(*) AS n FROM pred GROUP BY pred)
SELECT c.class_no, c.class_name, coalesce(h.n, 0) AS n
FROM (SELECT unnest(range(0, %d)) ::INTEGER AS class_no, unnest(%s) AS class_name) c LEFT JOIN h USING (class_no)"""
          % (K, "[" + ", ".join(S.q(x) for x in LANGS) + "]"))
def q_class_hist(spark, sf_dir):
    from vellum.operators.report import class_histogram
    _, p = _preds(spark, sf_dir)
    return class_histogram(p, _classes_df(spark))


@register("loss_metrics", W + """
SELECT count(*) AS n, round(avg(-ln(p)), 6) AS cross_entropy
FROM prob JOIN d USING (doc_id) WHERE NOT d.is_train AND prob.class_no = d.label""")
def q_loss(spark, sf_dir):
    m, sc = _scored(spark, sf_dir)
    t = sc.join(m.docs.filter(~F.col("is_train")).select("doc_id", "label"), "doc_id")
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(EV.cross_entropy()), 6).alias("cross_entropy"))


# ---------------------------------------------------------------- MC dropout
MC_N, MC_P, MC_SEED = 10, 0.1, 42

_MC_SQL = W + f""",
samp AS (SELECT unnest(range(1, {MC_N + 1})) AS sample),
fk AS (SELECT f.doc_id, f.term, s.sample, f.x / (1 - {MC_P}) AS x FROM feat f, samp s
       WHERE {S.key_hash("CAST(f.doc_id AS VARCHAR) || ':' || f.term || ':' || CAST(s.sample AS VARCHAR) || ':' || '" + str(MC_SEED) + "'")} / 4294967296.0 >= {MC_P}),
ml AS (SELECT ds.doc_id, ds.sample, ds.class_no, any_value(b.b) + coalesce(sum(fk.x * w.w), 0) AS z
       FROM (SELECT doc_id, sample, class_no FROM d, samp, classes) ds JOIN b USING (class_no)
       LEFT JOIN fk ON fk.doc_id = ds.doc_id AND fk.sample = ds.sample
       LEFT JOIN w ON w.term = fk.term AND w.class_no = ds.class_no
       GROUP BY ds.doc_id, ds.sample, ds.class_no),
mm AS (SELECT *, max(z) OVER (PARTITION BY doc_id, sample) AS m FROM ml),
mp AS (SELECT doc_id, sample, class_no, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY doc_id, sample) AS p FROM mm),
mc AS (SELECT doc_id, class_no, avg(p) AS mc_mean, stddev_pop(p) AS mc_std FROM mp GROUP BY doc_id, class_no)"""


def _mc(spark, sf_dir):
    m = lang_model(spark, sf_dir)
    return SC.mc_dropout(m.packed, m.weights, m.bias, m.docs.select("doc_id"), K, MC_N, MC_P, MC_SEED)


@register("mc_dropout", _MC_SQL + """
SELECT doc_id, class_no, round(mc_mean, 6) AS mc_mean, round(mc_std, 6) AS mc_std FROM mc""")
def q_mc(spark, sf_dir):
    return _mc(spark, sf_dir).select("doc_id", "class_no", F.round("mc_mean", 6).alias("mc_mean"),
                                     F.round("mc_std", 6).alias("mc_std"))


# Column names of the output format, written out for the check.
MC_NAMES = ("1: en", "2: fr", "3: de", "4: es")
PROB_COLUMNS = ("Probability Distribution 1: en", "Probability Distribution 2: fr",
                "Probability Distribution 3: de", "Probability Distribution 4: es")


def _mc_cols_sql():
    parts = []
    for k in range(K):
        name = MC_NAMES[k]
        parts.append(f'round(max(CASE WHEN class_no = {k} THEN mc_mean END), 6) AS "MC Mean Probability Dist {name}"')
        parts.append(f'round(max(CASE WHEN class_no = {k} THEN mc_std END), 6) AS "MC Std Probability Dist {name}"')
    return _MC_SQL + "\nSELECT doc_id, " + ", ".join(parts) + " FROM mc GROUP BY doc_id"


@register("mc_dropout_columns", _mc_cols_sql())
def q_mc_cols(spark, sf_dir):
    wide = SC.mc_dropout_columns(_mc(spark, sf_dir), list(LANGS))
    return wide.select("doc_id", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in wide.columns if c != "doc_id"])


# ---------------------------------------------------------------- Fisher information
_FISHER_SQL = W + f""",
tr AS (SELECT doc_id, label, (row_number() OVER (ORDER BY {S.key_hash('doc_id')}, doc_id) - 1) // {BATCH} AS batch
       FROM d WHERE is_train),
nb AS (SELECT count(DISTINCT batch) AS T FROM tr),
bs AS (SELECT batch, count(*) AS bs FROM tr GROUP BY batch),
res AS (SELECT tr.doc_id, tr.batch, prob.class_no, prob.p - CASE WHEN tr.label = prob.class_no THEN 1 ELSE 0 END AS r
        FROM tr JOIN prob USING (doc_id)),
gw AS (SELECT res.batch, res.class_no, feat.term, sum(res.r * feat.x) / any_value(bs.bs) AS g
       FROM res JOIN feat USING (doc_id) JOIN bs USING (batch) GROUP BY res.batch, res.class_no, feat.term),
gb AS (SELECT res.batch, res.class_no, sum(res.r) / any_value(bs.bs) AS g FROM res JOIN bs USING (batch)
       GROUP BY res.batch, res.class_no),
fw AS (SELECT class_no, term, (1 - {BETA2}) / (1 - pow({BETA2}, any_value(T))) * sum(pow({BETA2}, T - 1 - batch) * g * g) AS fim
       FROM gw, nb GROUP BY class_no, term),
fb AS (SELECT class_no, (1 - {BETA2}) / (1 - pow({BETA2}, any_value(T))) * sum(pow({BETA2}, T - 1 - batch) * g * g) AS fim
       FROM gb, nb GROUP BY class_no),
fim AS (SELECT 'weight' AS param, w.class_no, w.term, coalesce(fw.fim, 0) AS fim FROM w LEFT JOIN fw USING (class_no, term)
        UNION ALL SELECT 'bias', b.class_no, '', coalesce(fb.fim, 0) FROM b LEFT JOIN fb USING (class_no)),
var AS (SELECT param, class_no, term, fim,
               CASE WHEN isnan(1.0 / (fim + 1e-12)) OR isinf(1.0 / (fim + 1e-12)) THEN 1e8 ELSE 1.0 / (fim + 1e-12) END AS variance
        FROM fim)"""


_FISHER_CACHE: dict = {}


def fisher_tables(spark, sf_dir):
    """(model, scores, variance table with param/class_no/term/fim/variance; terms as in ``m.coded``).

    The variance table (classes × vocabulary + classes rows) is persisted: the bias
    variances collected to the driver and the per-document propagation read the same
    gradients, computed once.
    """
    from vellum.plans import model_fixture
    key = (id(spark), sf_dir, id(model_fixture._CACHE.get((id(spark), sf_dir))))
    if key in _FISHER_CACHE:
        return _FISHER_CACHE[key]
    m, sc = _scored(spark, sf_dir)
    train = m.docs.filter("is_train").select("doc_id", "label")
    batches = global_index(train.withColumn("h", key_hash("doc_id")), [F.col("h"), F.col("doc_id")], "idx") \
        .select("doc_id", (F.col("idx") / BATCH).cast("long").alias("batch"))
    n_batches = batches.agg(F.countDistinct("batch")).first()[0]
    feats = m.coded.select("doc_id", "term", "x")
    gw, gb = SC.batch_gradients(feats, sc, train, batches, K)
    fw = SC.fisher_accumulate(gw, n_batches, BETA2)
    fb = SC.fisher_accumulate(gb, n_batches, BETA2, keys=("class_no",))
    wv = (m.coded_weights.select("class_no", "term").join(fw, ["class_no", "term"], "left")
                   .select(F.lit("weight").alias("param"), "class_no", "term", F.coalesce("fim", F.lit(0.0)).alias("fim")))
    bv = (m.bias.select("class_no").join(fb, "class_no", "left")
                .select(F.lit("bias").alias("param"), F.col("class_no").cast("int"), F.lit("" if m.places is None else -1).alias("term"),
                        F.coalesce("fim", F.lit(0.0)).alias("fim")))
    var = reuse(SC.fisher_variance(wv.unionByName(bv)))
    _FISHER_CACHE.clear()
    _FISHER_CACHE[key] = (m, sc, var)
    return m, sc, var


@register("fisher_accumulate", _FISHER_SQL + """
SELECT param, class_no, term, round(fim * 1e6, 9) AS fim_e6 FROM fim""")
def q_fisher(spark, sf_dir):
    m, _, var = fisher_tables(spark, sf_dir)
    return m.named(var).select("param", "class_no", "term", F.round(F.col("fim") * 1e6, 9).alias("fim_e6"))


@register("fisher_variance", _FISHER_SQL + """
SELECT param, class_no, term, round(log10(variance), 6) AS log10_variance FROM var""")
def q_fisher_var(spark, sf_dir):
    m, _, var = fisher_tables(spark, sf_dir)
    return m.named(var).select("param", "class_no", "term", F.round(F.log10("variance"), 6).alias("log10_variance"))


# ---------------------------------------------------------------- uncertainty per document
_UNC_SQL = _FISHER_SQL + """,
zz AS (SELECT dc.doc_id, dc.class_no,
              coalesce(sum(feat.x * feat.x * vw.variance), 0) + any_value(vb.variance) AS z
       FROM (SELECT doc_id, class_no FROM d, classes) dc
       JOIN (SELECT class_no, variance FROM var WHERE param = 'bias') vb USING (class_no)
       LEFT JOIN feat ON feat.doc_id = dc.doc_id
       LEFT JOIN (SELECT class_no, term, variance FROM var WHERE param = 'weight') vw
              ON vw.term = feat.term AND vw.class_no = dc.class_no
       GROUP BY dc.doc_id, dc.class_no),
pz AS (SELECT prob.doc_id, prob.class_no, prob.p, zz.z FROM prob JOIN zz USING (doc_id, class_no)),
unc AS (SELECT doc_id, class_no, p,
               p * p * (z * (1 - p) * (1 - p) + (sum(p * p * z) OVER (PARTITION BY doc_id) - p * p * z)) AS v
        FROM pz)"""


def uncertainty_table(spark, sf_dir):
    m, _, var = fisher_tables(spark, sf_dir)
    wv = var.filter(F.col("param") == "weight").select("class_no", "term", "variance")
    bv = var.filter(F.col("param") == "bias").select("class_no", "variance")
    return m, SC.softmax_uncertainty(m.coded, m.coded_weights, m.bias, wv, bv, m.docs.select("doc_id"), K)


@register("softmax_uncertainty", _UNC_SQL + """
SELECT doc_id, class_no, round(p, 6) AS prob, round(log10(v), 6) AS log10_variance FROM unc""")
def q_unc(spark, sf_dir):
    _, u = uncertainty_table(spark, sf_dir)
    rows = u.select("doc_id", F.posexplode(F.arrays_zip("probs", "variance")).alias("class_no", "z"))
    return rows.select("doc_id", F.col("class_no").cast("int").alias("class_no"), F.round("z.probs", 6).alias("prob"),
                       F.round(F.log10("z.variance"), 6).alias("log10_variance"))


@register("probability_interval", _UNC_SQL + """,
iv AS (SELECT doc_id, class_no, p AS mean, sqrt(greatest(v, 1e-15)) AS std FROM unc),
lh AS (SELECT *, mean - 2 * std AS lo, mean + 2 * std AS hi FROM iv),
rg AS (SELECT *, min(lo) OVER (PARTITION BY doc_id) AS rlo, max(hi) OVER (PARTITION BY doc_id) AS rhi FROM lh)
SELECT doc_id, class_no, round(std, 6) AS std, round(lo, 6) AS lo, round(hi, 6) AS hi,
       round(CASE WHEN rhi - rlo = 0 THEN -0.5 ELSE rlo - (rhi - rlo) * 0.1 END, 6) AS range_lo,
       round(CASE WHEN rhi - rlo = 0 THEN 1.5 ELSE rhi + (rhi - rlo) * 0.1 END, 6) AS range_hi
FROM rg""")
def q_interval(spark, sf_dir):
    _, u = uncertainty_table(spark, sf_dir)
    iv = SC.probability_interval(u)
    return iv.select("doc_id", "class_no", *[F.round(c, 6).alias(c) for c in ("std", "lo", "hi", "range_lo", "range_hi")])


def _fmt_list_sql(col, fmt):
    return f"array_to_string(list_transform(list({col} ORDER BY class_no), lambda x: printf('{fmt}', x)), ',')"


@register("finetune_results", _UNC_SQL + f"""
SELECT unc.doc_id, any_value(d.label) AS gold_label, {_fmt_list_sql('p', '%.6f')} AS prob_distribution,
       {_fmt_list_sql('v', '%.6e')} AS uncertainty_distribution
FROM unc JOIN d USING (doc_id) WHERE NOT d.is_train GROUP BY unc.doc_id""")
def q_finetune(spark, sf_dir):
    m, u = uncertainty_table(spark, sf_dir)
    u = reuse(u)    # one row a document, read as scores and as uncertainties
    test = m.docs.filter(~F.col("is_train")).select("doc_id", F.col("label").alias("gold_label"))
    fmt = lambda c, f: F.array_join(F.transform(c, lambda x: F.format_string(f, x)), ",")
    rows = SC.finetune_results(test, u.select("doc_id", "probs"), u.select("doc_id", "variance"))
    return rows.select("doc_id", "gold_label", fmt(F.col("prob_distribution"), "%.6f").alias("prob_distribution"),
                       fmt(F.col("diamond_uncertainty"), "%.6e").alias("uncertainty_distribution"))


# ---------------------------------------------------------------- wide / long prediction tables
def _prob_cols():
    return list(PROB_COLUMNS)


_PIVOT_SQL = W + ",\npiv AS (SELECT doc_id, " + ", ".join(
    f'round(max(CASE WHEN class_no = {k} THEN p END), 6) AS "{c}"' for k, c in enumerate(_prob_cols())) + \
    " FROM prob GROUP BY doc_id)"


@register("pivot_predictions", _PIVOT_SQL + "\nSELECT * FROM piv")
def q_pivot(spark, sf_dir):
    from vellum.operators.tables import pivot_predictions
    _, sc = _scored(spark, sf_dir)
    wide = pivot_predictions(sc, list(LANGS))
    return wide.select("doc_id", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in wide.columns[1:]])


@register("melt_predictions", _PIVOT_SQL + """,
m AS (UNPIVOT piv ON COLUMNS(* EXCLUDE (doc_id)) INTO NAME column_name VALUE value)
SELECT doc_id, column_name, 'probability distribution' AS pred_type,
       CAST(regexp_extract(column_name, '(\\d+)\\s*:', 1) AS INTEGER) AS number,
       trim(regexp_extract(column_name, ':\\s*(.*)$', 1)) AS word, value FROM m""")
def q_melt(spark, sf_dir):
    from vellum.operators.tables import melt_predictions, pivot_predictions
    _, sc = _scored(spark, sf_dir)
    wide = pivot_predictions(sc, list(LANGS))
    wide = wide.select("doc_id", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in wide.columns[1:]])
    return melt_predictions(wide, id_cols=["doc_id"]).select("doc_id", "column_name", "pred_type", "number", "word", "value")


# ---------------------------------------------------------------- ablation
CURVE_STEP = 0.1
SCHED = None


def _sched_sql():
    from vellum.operators.evaluate import retention_schedule
    return "[" + ", ".join(repr(float(f)) for f in retention_schedule(CURVE_STEP)) + "]::DOUBLE[]"


def _ablation_inputs(spark, sf_dir):
    m, sc, var = fisher_tables(spark, sf_dir)
    test = m.docs.filter(~F.col("is_train")).select("doc_id", "label")
    feats = m.coded.filter(~F.col("is_train")).select("doc_id", "term", "x")
    wv = var.filter(F.col("param") == "weight").select(
        "class_no", "term", F.round(F.log10("variance"), 9).alias("variance"))
    return m, sc, test, feats, wv


_TEST_FEAT_SQL = """
tf AS (SELECT feat.doc_id, feat.term, feat.x FROM feat WHERE NOT feat.is_train),
tl AS (SELECT doc_id, label FROM d WHERE NOT is_train)"""


def _curve_sql(masked_cte: str, key: str) -> str:
    """SQL for F1 per key given a CTE mw(key, class_no, term, w) and key list kl(key)."""
    return f""",
{masked_cte},
cl AS (SELECT tl.doc_id, tl.label, kl.{key}, classes.class_no, b.b
       FROM tl, kl, classes JOIN b USING (class_no)),
cz AS (SELECT cl.doc_id, cl.label, cl.{key}, cl.class_no, any_value(cl.b) + coalesce(sum(tf.x * mw.w), 0) AS z
       FROM cl LEFT JOIN tf ON tf.doc_id = cl.doc_id
       LEFT JOIN mw ON mw.{key} = cl.{key} AND mw.class_no = cl.class_no AND mw.term = tf.term
       GROUP BY cl.doc_id, cl.label, cl.{key}, cl.class_no),
cp AS (SELECT doc_id, label, {key}, min(class_no) AS pred FROM
       (SELECT *, max(z) OVER (PARTITION BY doc_id, {key}) AS mz FROM cz) WHERE z = mz GROUP BY doc_id, label, {key}),
""" + metrics_sql("cp", [key]).lstrip().lstrip(",")


_RET_SQL = _FISHER_SQL + "," + _TEST_FEAT_SQL + """,
vr AS (SELECT class_no, term, row_number() OVER (ORDER BY round(log10(variance), 9), class_no, term) - 1 AS r
       FROM var WHERE param = 'weight'),
np_ AS (SELECT count(*) AS N FROM vr),
kl AS (SELECT unnest(%s) AS fraction)""" % _sched_sql() + _curve_sql(
    """mw AS (SELECT kl.fraction, vr.class_no, vr.term,
              CASE WHEN vr.r < greatest(1, floor(kl.fraction * np_.N)) THEN w.w ELSE 0 END AS w
       FROM kl, vr JOIN w USING (class_no, term), np_)""", "fraction")


@register("f1_retention_curve", _RET_SQL + """
SELECT fraction, round(accuracy, 6) AS accuracy, round(weighted_f1, 6) AS weighted_f1, n FROM met""")
def q_retention(spark, sf_dir):
    from vellum.operators import ablation as AB
    m, sc, test, feats, wv = _ablation_inputs(spark, sf_dir)
    ranked = EV.ranked_parameters(wv)
    c = AB.f1_retention_curve(feats, test, m.coded_weights, m.bias, ranked, K, CURVE_STEP)
    return c.select("fraction", F.round("accuracy", 6).alias("accuracy"), F.round("weighted_f1", 6).alias("weighted_f1"), "n")


_VOCAB_RET_SQL = _FISHER_SQL + "," + _TEST_FEAT_SQL + """,
tv AS (SELECT term, avg(round(log10(variance), 9)) AS mv FROM var WHERE param = 'weight' GROUP BY term),
vr AS (SELECT term, row_number() OVER (ORDER BY round(mv, 9), term) - 1 AS r FROM tv),
np_ AS (SELECT count(*) AS N FROM vr),
kl AS (SELECT unnest(%s) AS fraction)""" % _sched_sql() + _curve_sql(
    """mw AS (SELECT kl.fraction, w.class_no, vr.term,
              CASE WHEN vr.r < greatest(1, floor(kl.fraction * np_.N)) THEN w.w ELSE 0 END AS w
       FROM kl, vr JOIN w USING (term), np_)""", "fraction")


@register("f1_vocabulary_retention", _VOCAB_RET_SQL + """
SELECT fraction, round(accuracy, 6) AS accuracy, round(weighted_f1, 6) AS weighted_f1, n FROM met""")
def q_vocab_retention(spark, sf_dir):
    from vellum.operators import ablation as AB
    from vellum.operators.ranking import global_index as gi
    m, sc, test, feats, wv = _ablation_inputs(spark, sf_dir)
    tv = wv.groupBy("term").agg(F.round(F.avg("variance"), 9).alias("mv"))
    term_rank = gi(tv, [F.col("mv"), F.col("term")], "rank").select("term", "rank")
    c = AB.f1_vocabulary_retention(feats, test, m.coded_weights, m.bias, term_rank, K, CURVE_STEP)
    return c.select("fraction", F.round("accuracy", 6).alias("accuracy"), F.round("weighted_f1", 6).alias("weighted_f1"), "n")


@register("f1_bias_removal", W + "," + _TEST_FEAT_SQL + """,
bl AS (SELECT tl.doc_id, tl.label, r.removed_class, logit.class_no,
              logit.z - CASE WHEN logit.class_no = r.removed_class THEN b.b ELSE 0 END AS z
       FROM tl JOIN logit USING (doc_id) JOIN b ON b.class_no = logit.class_no,
            (SELECT class_no AS removed_class FROM classes) r),
bp AS (SELECT doc_id, label, removed_class, min(class_no) AS pred FROM
       (SELECT *, max(z) OVER (PARTITION BY doc_id, removed_class) AS mz FROM bl) WHERE z = mz
       GROUP BY doc_id, label, removed_class),""" + metrics_sql("bp", ["removed_class"]).lstrip().lstrip(",") + """
SELECT removed_class, round(accuracy, 6) AS accuracy, round(weighted_f1, 6) AS weighted_f1, n FROM met""")
def q_bias_removal(spark, sf_dir):
    from vellum.operators import ablation as AB
    m, sc = _scored(spark, sf_dir)
    test = m.docs.filter(~F.col("is_train")).select("doc_id", "label")
    r = AB.f1_bias_removal(sc, test, m.bias, K)
    return r.select("removed_class", F.round("accuracy", 6).alias("accuracy"),
                    F.round("weighted_f1", 6).alias("weighted_f1"), "n")


REMOVE_M = 10


@register("f1_feature_removal", W + "," + _TEST_FEAT_SQL + f""",
topf AS (SELECT term AS removed FROM st WHERE term IN (SELECT term FROM vocab) ORDER BY cf DESC, term LIMIT {REMOVE_M}),
fl AS (SELECT tl.doc_id, tl.label, t.removed, logit.class_no,
              logit.z - coalesce((SELECT tf.x FROM tf WHERE tf.doc_id = tl.doc_id AND tf.term = t.removed), 0)
                      * (SELECT w.w FROM w WHERE w.term = t.removed AND w.class_no = logit.class_no) AS z
       FROM tl JOIN logit USING (doc_id), topf t),
fp AS (SELECT doc_id, label, removed, min(class_no) AS pred FROM
       (SELECT *, max(z) OVER (PARTITION BY doc_id, removed) AS mz FROM fl) WHERE z = mz
       GROUP BY doc_id, label, removed),""" + metrics_sql("fp", ["removed"]).lstrip().lstrip(",") + """
SELECT removed, round(accuracy, 6) AS accuracy, round(weighted_f1, 6) AS weighted_f1, n FROM met""")
def q_feature_removal(spark, sf_dir):
    from vellum.operators import ablation as AB
    m, sc = _scored(spark, sf_dir)
    test = m.docs.filter(~F.col("is_train")).select("doc_id", "label")
    stats = m.counts.join(m.vocab, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("cf"))
    terms = [r[0] for r in stats.orderBy(F.desc("cf"), "term").limit(REMOVE_M).collect()]   # M names
    feats = m.features.filter(~F.col("is_train")).select("doc_id", "term", "x")
    r = AB.f1_feature_removal(feats, sc, test, m.weights, terms, K)
    return r.select("removed", F.round("accuracy", 6).alias("accuracy"),
                    F.round("weighted_f1", 6).alias("weighted_f1"), "n")


N_SLICES = 5


@register("slice_f1", W + f""",
sl AS (SELECT doc_id, label, pred,
              CAST(least(floor((row_number() OVER (ORDER BY doc_id) - 1) / (SELECT greatest(count(*) // {N_SLICES}, 1) FROM test)),
                         {N_SLICES - 1}) AS INTEGER) AS slice FROM test),""" + metrics_sql("sl", ["slice"]).lstrip().lstrip(",")
          + "," + metrics_sql("test", [], "all_") + """
SELECT slice, round(weighted_f1, 6) AS weighted_f1, n,
       round(avg(weighted_f1) OVER (), 6) AS mean_f1, round(stddev_pop(weighted_f1) OVER (), 6) AS std_f1,
       round((SELECT weighted_f1 FROM all_met), 6) AS chosen_f1,
       round(((SELECT weighted_f1 FROM all_met) - avg(weighted_f1) OVER ()) / greatest(stddev_pop(weighted_f1) OVER (), 1e-12), 6) AS z
FROM met""")
def q_slice_f1(spark, sf_dir):
    m, p = _preds(spark, sf_dir)
    pairs = p.join(m.docs.filter(~F.col("is_train")).select("doc_id", "label"), "doc_id").select("doc_id", "label", "pred")
    r = EV.slice_f1(pairs, N_SLICES)
    return r.select("slice", *[F.round(c, 6).alias(c) if c != "n" else F.col(c)
                               for c in ("weighted_f1", "n", "mean_f1", "std_f1", "chosen_f1", "z")])


KEEP_N = 0.3


@register("keep_lowest_variance", _FISHER_SQL + f""",
vr AS (SELECT class_no, term, row_number() OVER (ORDER BY round(log10(variance), 9), class_no, term) - 1 AS r
       FROM var WHERE param = 'weight')
SELECT class_no, term FROM vr WHERE r < greatest(1, floor({KEEP_N} * (SELECT count(*) FROM vr)))""")
def q_keep_lowest(spark, sf_dir):
    m, _, var = fisher_tables(spark, sf_dir)
    wv = var.filter(F.col("param") == "weight").select("class_no", "term", F.round(F.log10("variance"), 9).alias("variance"))
    return m.named(EV.keep_lowest_variance(wv, KEEP_N)).select("class_no", "term")


def _class_name_sql():
    return "CASE class_no " + " ".join(f"WHEN {k} THEN '{lang}'" for k, lang in enumerate(LANGS)) + " END"


@register("variance_by_group", _FISHER_SQL + f"""
SELECT param, -1 AS class_no, 'all' AS class_name, round(log10(avg(variance)), 6) AS log10_mean,
       round(log10(greatest(1e-15, avg(variance))), 6) AS log10_floored FROM var GROUP BY param
UNION ALL
SELECT 'bias' AS param, class_no, {_class_name_sql()} AS class_name, round(log10(variance), 6),
       round(log10(greatest(1e-15, variance)), 6) FROM var WHERE param = 'bias'""")
def q_var_group(spark, sf_dir):
    _, _, var = fisher_tables(spark, sf_dir)
    g = EV.variance_by_group(var, list(LANGS))
    return g.select("param", "class_no", "class_name", *[F.round(c, 6).alias(c) for c in ("log10_mean", "log10_floored")])


def _hist_sql(value: str, bins: int) -> str:
    def one(keysel, part):
        return f"""SELECT {keysel} AS class_no, CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor(({value} - mn) / ((mx - mn) / {bins})), {bins - 1}) END AS INTEGER) AS bin
               FROM (SELECT *, min({value}) OVER ({part}) AS mn, max({value}) OVER ({part}) AS mx FROM var WHERE param = 'weight')"""
    return f"""
SELECT class_no, bin, count(*) AS n FROM ({one('-1', '')} UNION ALL {one('class_no', 'PARTITION BY class_no')})
GROUP BY class_no, bin"""


@register("variance_histogram", _FISHER_SQL + _hist_sql("variance", 50))
def q_var_hist(spark, sf_dir):
    _, _, var = fisher_tables(spark, sf_dir)
    wv = var.filter(F.col("param") == "weight").select("class_no", "variance")
    overall = EV.histogram(wv, "variance", 50).select(F.lit(-1).alias("class_no"), "bin", "n")
    per = EV.histogram(wv, "variance", 50, ["class_no"]).select("class_no", "bin", "n")
    return overall.unionByName(per)


def _log_hist_sql() -> str:
    def one(keysel, part):
        return f"""SELECT {keysel} AS class_no,
                   CAST(CASE WHEN variance < 1 THEN 0 ELSE least(floor(log10(variance)) + 1, ceil(log10(greatest(1, mx)))) END AS INTEGER) AS bin
               FROM (SELECT *, max(variance) OVER ({part}) AS mx FROM var WHERE param = 'weight')"""
    return f"""
SELECT class_no, bin, count(*) AS n FROM ({one('-1', '')} UNION ALL {one('class_no', 'PARTITION BY class_no')})
GROUP BY class_no, bin"""


@register("variance_log_histogram", _FISHER_SQL + _log_hist_sql())
def q_var_log_hist(spark, sf_dir):
    _, _, var = fisher_tables(spark, sf_dir)
    wv = var.filter(F.col("param") == "weight").select("class_no", "variance")
    overall = EV.log_histogram(wv, "variance").select(F.lit(-1).alias("class_no"), "bin", "n")
    per = EV.log_histogram(wv, "variance", ["class_no"]).select("class_no", "bin", "n")
    return overall.unionByName(per)


@register("variance_store", _FISHER_SQL + """
SELECT param, class_no, term, round(log10(variance), 6) AS log10_variance FROM var""")
def q_variance_store(spark, sf_dir):
    from vellum.sources.documents import load_variance, save_variance, scratch_path
    m, _, var = fisher_tables(spark, sf_dir)
    var = m.named(var)
    base = scratch_path(spark, "variance")
    save_variance(var.select("param", "class_no", "term", "variance"), base, "v1")
    save_variance(var.select("param", "class_no", "term", (F.col("variance") * 2).alias("variance")), base, "v2")
    back = load_variance(spark, base, "v1")
    return back.select("param", "class_no", "term", F.round(F.log10("variance"), 6).alias("log10_variance"))
