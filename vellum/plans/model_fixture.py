"""The SQL-checkable model behind the scoring / uncertainty / ablation queries.

Documents are classified by language (4 classes) with closed-form smoothed class
log-likelihood weights fitted on the key-hash training split. Every downstream operator
is then an exact relational computation that DuckDB can repeat. Spark side here, the
equivalent SQL CTEs below.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import features as FE
from vellum.operators import packed as P
from vellum.operators import scoring as SC
from vellum.operators import tokens as TK
from vellum.operators.common import key_hash, reuse
from vellum.operators.textops import map_labels
from vellum.plans import sqlgen as S
from vellum.plans.inputs import table

# --- fixed values: class list and vocabulary settings of the checked model ---------
LANGS = ("en", "fr", "de", "es")
K = len(LANGS)
MIN_DF, MAX_DF = 5, 0.9
TRAIN_SHARE = 80
BATCH = 25
BETA2 = 0.999


@dataclass
class LangModel:
    docs: DataFrame        # doc_id, label, split, is_train, source, n_chars
    counts: DataFrame      # doc_id, label, is_train, term, n
    vocab: DataFrame       # term
    features: DataFrame    # doc_id, label, is_train, term, n, x
    packed: DataFrame      # the features in one row per document (as ``features``, beyond the limit)
    weights: DataFrame     # class_no, term, w
    bias: DataFrame        # class_no, b
    n_docs: int
    places: DataFrame | None    # term, place (in byte order); None beyond the limit: the two below are as above then
    coded: DataFrame       # ``packed`` with places for terms
    coded_weights: DataFrame    # ``weights`` with places for terms

    def named(self, df: DataFrame) -> DataFrame:
        """A table keyed by ``term`` with the terms' names (without a place: empty)."""
        if self.places is None:
            return df
        names = self.places.select(F.col("place").alias("_place"), F.col("term").alias("_name"))
        return df.join(names, F.col("term") == F.col("_place"), "left").withColumn("term", F.coalesce("_name", F.lit(""))).drop("_place", "_name")


_CACHE: dict = {}


def lang_model(spark: SparkSession, sf_dir: str) -> LangModel:
    key = (id(spark), sf_dir)
    if key in _CACHE:
        return _CACHE[key]
    raw = table(spark, sf_dir, "documents")
    n_docs = raw.count()
    d = map_labels(raw, "lang", {lang: i for i, lang in enumerate(LANGS)})
    d = d.withColumn("is_train", (key_hash("doc_id") % 100) < TRAIN_SHARE)
    docs = d.select("doc_id", "label", "is_train", "source", "n_chars")
    # A document's counts stay in its row; they are taken apart where terms are grouped.
    rows = reuse(d.select("doc_id", "label", "is_train", TK.counted_tokens("text").alias("c")).select("doc_id", "label", "is_train", "c.words", "c.n"))
    counts = P.unpack_words(rows)
    vocab = reuse(FE.count_vectorise(counts, "doc_id", "term", "n", MIN_DF, MAX_DF, None, n_docs, stats=P.word_frequencies(rows))
                  .select("term"))
    names = P.small_table(vocab, P.PLACED_ROWS)
    class_docs = docs.filter("is_train").groupBy(F.col("label").alias("class_no")).agg(F.count(F.lit(1)).alias("docs"))
    # Partitioned by document once; scores, residuals and uncertainty all read this table.
    if names is not None:
        known = P.terms_of(names)
        known = known.take(pc.sort_indices(known))
        held = rows.select("doc_id", "label", "is_train", P.placed("words", "n", known).alias("c"))
        totals = reuse(P.with_totals(held.select("doc_id", "label", "is_train", "c.term", "c.n")))
        coded = P.shares(totals)
        packed = coded.withColumn("term", P.named("term", known))
        features = P.unpack(packed, ("term", "n", "x"))
        places = vocab.select("term", P.place_of("term", known).alias("place"))
        terms = spark.range(len(known)).select(F.col("id").cast("int").alias("term"))
        train = P.unpack(totals.filter("is_train").select("label", "term", "n"), ("term", "n"))
    else:
        kept = counts.join(vocab, "term", "left_semi")
        features = packed = coded = reuse(kept.withColumn("x", F.col("n") / F.sum("n").over(Window.partitionBy("doc_id"))))
        places, terms, train = None, vocab, kept.filter("is_train")
    class_counts = reuse(train.groupBy(F.col("label").alias("class_no"), "term").agg(F.sum("n").alias("n")))
    w, b = SC.closed_form_weights(class_counts, class_docs, terms, K)
    coded_weights = reuse(w)
    m = LangModel(docs, counts, vocab, features, packed, coded_weights, reuse(b), n_docs, places, coded, coded_weights)
    m.weights = m.named(coded_weights)
    _CACHE[key] = m
    return m


# ---------------------------------------------------------------- SQL side
def model_ctes() -> str:
    """CTEs: d, cnt, vocab, feat, w, b, logit, prob (doc_id, class_no, z, p)."""
    cases = " ".join(f"WHEN '{lang}' THEN {i}" for i, lang in enumerate(LANGS))
    classes = "[" + ", ".join(str(i) for i in range(K)) + "]"
    return f"""
d AS (SELECT doc_id, CASE lang {cases} END AS label, ({S.key_hash('doc_id')} % 100) < {TRAIN_SHARE} AS is_train,
             source, n_chars, {S.filtered_tokens('text')} AS f FROM documents),
cnt AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(f) AS term FROM d) GROUP BY doc_id, term),
st AS (SELECT term, count(*) AS df, sum(n) AS cf FROM cnt GROUP BY term),
vocab AS (SELECT term FROM st WHERE df >= {MIN_DF} AND df <= {MAX_DF} * (SELECT count(*) FROM documents)),
feat AS (SELECT cnt.doc_id, cnt.term, cnt.n, cnt.n / sum(cnt.n) OVER (PARTITION BY cnt.doc_id) AS x,
                d.label, d.is_train
         FROM cnt JOIN d USING (doc_id) WHERE cnt.term IN (SELECT term FROM vocab)),
cc AS (SELECT label AS class_no, term, sum(n) AS n FROM feat WHERE is_train GROUP BY label, term),
nc AS (SELECT class_no, sum(n) AS nc FROM cc GROUP BY class_no),
classes AS (SELECT unnest({classes}) AS class_no),
w AS (SELECT g.class_no, g.term, ln((coalesce(cc.n, 0) + 1.0) / (coalesce(nc.nc, 0) + (SELECT count(*) FROM vocab))) AS w
      FROM (SELECT class_no, term FROM classes, vocab) g
      LEFT JOIN cc USING (class_no, term) LEFT JOIN nc USING (class_no)),
b AS (SELECT label AS class_no, ln(count(*) / (SELECT count(*) FROM d WHERE is_train)) AS b
      FROM d WHERE is_train GROUP BY label),
logit AS (SELECT dc.doc_id, dc.class_no, any_value(b.b) + coalesce(sum(feat.x * w.w), 0) AS z
          FROM (SELECT doc_id, class_no FROM d, classes) dc
          JOIN b USING (class_no)
          LEFT JOIN feat ON feat.doc_id = dc.doc_id
          LEFT JOIN w ON w.term = feat.term AND w.class_no = dc.class_no
          GROUP BY dc.doc_id, dc.class_no),
mz AS (SELECT doc_id, class_no, z, max(z) OVER (PARTITION BY doc_id) AS m FROM logit),
prob AS (SELECT doc_id, class_no, z, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY doc_id) AS p FROM mz),
pred AS (SELECT doc_id, min(class_no) AS pred
         FROM (SELECT doc_id, class_no, p, max(p) OVER (PARTITION BY doc_id) AS mp FROM prob)
         WHERE p = mp GROUP BY doc_id),
test AS (SELECT d.doc_id, d.label, pred.pred FROM d JOIN pred USING (doc_id) WHERE NOT d.is_train)"""
