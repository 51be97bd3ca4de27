"""One registered query per operator, over the driver's tables, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe_codec, hard_negatives, language_id, ngram_join, packing, piece_codec, quality_classifier, quality_rules, resampling, secret_scan, suffix_dedup, topk_search, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RULE_SQL = " + ".join(f"(CASE WHEN {c} THEN {quality_rules.BIT[r]} ELSE 0 END)" for r, c in quality_rules.RULES.items())


@register("op6_quality_rules", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE c >= 2) GROUP BY doc_id),
li AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
       FROM (SELECT doc_id, unnest(ls) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
             length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
      FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN li USING (doc_id)),
b AS (SELECT *, ({_RULE_SQL})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits, (fail_bits & {quality_rules.BASE}) <> 0 AS base_failed,
       (fail_bits & {quality_rules.POLICIES["v1"]}) = 0 AS kept FROM b
""")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
                       (F.col("fail_bits").bitwiseAND(F.lit(quality_rules.BASE)) != 0).alias("base_failed"), "kept")


@register("op5_topk_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk_search.quantise("embedding").alias("vector"))
    return topk_search.top_k(rows, rows.filter(F.col("vec_id") % 100 == 0), k=10)


def _rule_sql(value: str) -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r.name))
    cases = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'" for r in rules)
    return f"CASE {cases} END"


_LISTED_SQL = f"regexp_matches(host, '(^|\\.)({'|'.join(url_filter.NAMES)})\\.')"


@register("op8_url_filter", rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, {_rule_sql("name")} AS rule, ({_LISTED_SQL}) AS listed,
       coalesce({_rule_sql("verdict")}, CASE WHEN {_LISTED_SQL} THEN 'block' ELSE 'allow' END) AS verdict FROM p
""")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.variants(url_filter.NAMES, pages))


@register("op9_ngram_jaccard_join", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS gram
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b, common = na.n AND common = nb.n AS same FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 9 * common >= 4 * (na.n + nb.n)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
k AS (SELECT node, min(seen) AS class_id FROM r GROUP BY node),
l AS (SELECT a, count(*) AS links, min(CASE WHEN same THEN b END) AS copy FROM e GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(copy, doc_id)) AS copy_id, class_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(n, 0)::BIGINT AS n_grams
FROM documents JOIN k ON node = doc_id LEFT JOIN l ON a = doc_id LEFT JOIN n USING (doc_id)
""")
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_join(table(spark, sf_dir, "documents"))


@register("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


TOKENIZER = "byte_bpe_50k.json"


PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file that the queries use."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op10_bpe_codec")
def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@register("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _fold(n: int):
    """Remainder of the checksum of a document id, by which held-out rows are set."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@register("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(_fold(5) != 0))
    held = docs.withColumn("id", F.struct("doc_id", (_fold(5) == 0).alias("held_out")))
    return language_id.predict(held, model, id_col="id").select("id.doc_id", "id.held_out", "lang_pred", "score")


@register("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels.filter(_fold(3) != 1))
    held = docs.withColumn("id", F.struct("doc_id", (_fold(3) == 1).alias("held_out")))
    return quality_classifier.predict(held, model, id_col="id").select("id.doc_id", "id.held_out", "score", "predicted")


@register("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


@register("op11_piece_codec")
def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))
    return rows.select("doc_id", "n_tokens", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), "agrees")


@register("op12_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label, topk_search.quantise("embedding", 256).alias("vector"))
    return hard_negatives.mine(rows, rows.filter(F.col("vec_id") % 50 == 0))


@register("op13_importance_resampling")
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
