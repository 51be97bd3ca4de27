"""Registered feature queries (section 2.3) and table-shaping queries (section 2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import features as FE
from vellum.operators import rows as R
from vellum.operators import textops as TO
from vellum.operators import tokens as TK
from vellum.plans import sqlgen as S
from vellum.plans.inputs import table
from vellum.plans.q_text import _sql_clean_social
from vellum.plans.registry import register
from vellum.sources import documents as SD

_TOK_SQL = f"""
d AS (SELECT doc_id, {S.filtered_tokens('text')} AS f FROM documents),
cnt AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(f) AS term FROM d) GROUP BY doc_id, term)"""


def _counts(spark, sf_dir, ngram=False):
    d = TK.with_tokens(table(spark, sf_dir, "documents"), "text")
    terms = TK.ngrams("tokens", 1, 2) if ngram else F.col("tokens")
    return d, TK.term_counts(d, terms, ("doc_id",), "term")


@register("build_vocabulary", "WITH " + _TOK_SQL + """
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS token_id, sum(n) AS cf, count(*) AS df
FROM cnt GROUP BY term""")
def q_vocab(spark, sf_dir):
    _, c = _counts(spark, sf_dir)
    return FE.build_vocabulary(c).select("term", "token_id", "cf", "df")


@register("bag_of_words", "WITH " + _TOK_SQL + """,
v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS token_id FROM (SELECT DISTINCT term FROM cnt))
SELECT doc_id, CAST(token_id AS BIGINT) AS token_id, n FROM cnt JOIN v USING (term)""")
def q_bow(spark, sf_dir):
    _, c = _counts(spark, sf_dir)
    return FE.bag_of_words(c, FE.build_vocabulary(c))


@register("ngrams", f"""
WITH d AS (SELECT doc_id, {S.filtered_tokens('text')} AS f FROM documents)
SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({S.ngrams12('f')}) AS term FROM d) GROUP BY doc_id, term""")
def q_ngrams(spark, sf_dir):
    _, c = _counts(spark, sf_dir, ngram=True)
    return c


@register("count_vectorise", "WITH " + _TOK_SQL + """,
st AS (SELECT term, count(*) AS df, sum(n) AS cf FROM cnt GROUP BY term)
SELECT term, df, cf FROM st WHERE df >= 2 AND df <= 0.95 * (SELECT count(*) FROM documents)
ORDER BY cf DESC, term LIMIT 5000""")
def q_count_vec(spark, sf_dir):
    d, c = _counts(spark, sf_dir)
    n = table(spark, sf_dir, "documents").count()
    return FE.count_vectorise(c, min_df=2, max_df=0.95, max_features=5000, n_docs=n).select("term", "df", "cf")


@register("tfidf", f"""
WITH d AS (SELECT doc_id, {S.filtered_tokens('text')} AS f FROM documents),
cnt AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({S.ngrams12('f')}) AS term FROM d) GROUP BY doc_id, term),
st AS (SELECT term, count(*) AS df FROM cnt GROUP BY term),
nd AS (SELECT count(*) AS N FROM documents),
kept AS (SELECT term, ln((1.0 + N) / (1.0 + df)) + 1 AS idf FROM st, nd WHERE df >= 0.02 * N AND df <= 0.57 * N),
raw AS (SELECT doc_id, term, n * idf AS r FROM cnt JOIN kept USING (term))
SELECT doc_id, term, round(r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)), 6) AS w FROM raw""")
def q_tfidf(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    # A text is tokenised once; counting, weights and norms read what is written of it.
    d, _ = R.store(TK.with_tokens(table(spark, sf_dir, "documents"), "text").select("doc_id", "tokens"), "tokens")
    d = d.select("doc_id", TK.ngrams("tokens", 1, 2).alias("terms"))
    shared = TK.shared_counts(d, "terms", 0.02, n)
    if shared is not None:
        t = FE.tfidf(R.store(shared[0], "shared-counts")[0], min_df=0.02, max_df=0.57, n_docs=n, vocab=shared[1])
    else:
        t = FE.tfidf(TK.term_counts(d, F.col("terms")), min_df=0.02, max_df=0.57, n_docs=n)
    return t.select("doc_id", "term", F.round("w", 6).alias("w"))


# ---------------------------------------------------------------- sources and shaping
DOC_CFG = {"text_field": "text", "source_field": "source", "time_field": ""}
CONV_CFG = {"text_field": "text", "source_field": "", "time_field": "", "source": "conversations"}


@register("read_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_read(spark, sf_dir):
    return SD.read_documents(spark, f"{sf_dir}/documents.parquet", "parquet").select(
        "doc_id", "text", "lang", "source", "n_chars")


@register("normalise_documents", """
SELECT doc_id, text AS "Text", source AS "Source", '' AS "Time" FROM documents""")
def q_normalise(spark, sf_dir):
    return SD.normalise_documents(table(spark, sf_dir, "documents"), DOC_CFG)


def _conv_keyed(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))


@register("union_sources", """
SELECT 0 AS origin, doc_id, text AS "Text", source AS "Source", '' AS "Time" FROM documents
UNION ALL
SELECT 1, conv_id * 1000 + turn, text, 'conversations', '' FROM conversations""")
def q_union(spark, sf_dir):
    u = SD.normalise_documents(table(spark, sf_dir, "documents"), DOC_CFG)
    b = SD.normalise_documents(_conv_keyed(spark, sf_dir), CONV_CFG)
    return SD.union_sources(u, b).select("origin", "doc_id", "Text", "Source", "Time")


@register("sample_documents", """
SELECT doc_id, source FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def q_sample(spark, sf_dir):
    return SD.sample_documents(table(spark, sf_dir, "documents").select("doc_id", "source"), 100, True, 42)


@register("split_documents", f"""
SELECT doc_id, CASE WHEN {S.key_hash('doc_id')} % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM documents""")
def q_split(spark, sf_dir):
    return SD.split_documents(table(spark, sf_dir, "documents").select("doc_id"))


@register("attach_results", """
SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_attach(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return SD.attach_results(d, table(spark, sf_dir, "labels"))


@register("attach_truncated", """
SELECT a.doc_id, a.source, b.result_doc_id, b.quality
FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS p FROM documents) a
JOIN (SELECT doc_id AS result_doc_id, quality, row_number() OVER (ORDER BY doc_id) AS p FROM labels) b USING (p)""")
def q_attach_trunc(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return SD.attach_truncated(d, lab).select("doc_id", "source", "result_doc_id", "quality")


@register("write_results", """
SELECT d.doc_id, d.source, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_write(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    wide = SD.attach_results(d, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    path = SD.write_results(wide, SD.scratch_path(spark, "results"), "parquet")
    return spark.read.parquet(path)


@register("map_labels", """
SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 END AS label FROM documents""")
def q_map_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return TO.map_labels(d, "lang", {"en": 0, "fr": 1, "de": 2, "es": 3}).select("doc_id", F.col("label").cast("int"))


ENC_LEN = 32


@register("encode_fixed_length", "WITH " + _TOK_SQL + f""",
v AS (SELECT term, row_number() OVER (ORDER BY term) AS tid FROM (SELECT DISTINCT term FROM cnt)),
e AS (SELECT doc_id, list_slice(f, 1, {ENC_LEN}) AS s FROM d),
pos AS (SELECT doc_id, p, s[p] AS term FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS p FROM e)),
ids AS (SELECT doc_id, list(tid ORDER BY p) AS l FROM pos JOIN v USING (term) GROUP BY doc_id)
SELECT e.doc_id,
       array_to_string(list_concat(coalesce(ids.l, []), list_transform(range(0, {ENC_LEN} - len(e.s)), lambda x: 0)), ',') AS input_ids,
       len(e.s) AS mask_sum
FROM e LEFT JOIN ids USING (doc_id)""")
def q_encode(spark, sf_dir):
    d, c = _counts(spark, sf_dir)
    vocab = FE.build_vocabulary(c)
    enc = TO.encode_fixed_length(d.select("doc_id", "tokens"), vocab, ENC_LEN)
    return enc.select("doc_id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("mask_sum"))


@register("prepare_training_table", f"""
WITH d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 END AS label,
                  CASE WHEN {S.key_hash('doc_id')} % 100 < 80 THEN 'train' ELSE 'test' END AS split, text
           FROM documents)
SELECT doc_id, label, split, {_sql_clean_social('text')} AS clean_text FROM d""")
def q_prepare(spark, sf_dir):
    return TO.prepare_training_table(table(spark, sf_dir, "documents"), {"text_field": "text", "label_field": "lang"}, {"en": 0, "fr": 1, "de": 2, "es": 3})
