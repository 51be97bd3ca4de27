"""Training corpus pipeline: rules, near duplicates, repeated passages, secrets, packing.

Each stage is ``function(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``; every stage works on all its predecessor kept.

Defined results, for every stage: null and empty texts, repeated rows, rows without an id,
further columns (whatever their names) and empty tables are allowed. A text without words
fails the rules. Rows without an id count as documents of their own and are never dropped as
duplicates of rows with one. Rows that share an id are one document for the near-duplicate stage,
which keeps the one with the smallest text. Further columns are carried to the packing stage, which returns its pieces only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import ngram_join, packing, quality_rules, secret_scan, suffix_dedup
from vellum.llm.lineage import materialise
from vellum.llm.queries import tokenizer_path


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy ``v1`` of the rule ledger."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = quality_rules.apply_policy(quality_rules.ledger(rows, text="row.text", id_col="row"), "v1").filter("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of the smallest id."""
    found = ngram_join.similarity_join(docs)
    gone = found.filter(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    again = docs.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1")
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("row"))
    return once.select("row.*").unionByName(kept.filter("doc_id IS NULL"))


def repeated_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of an earlier 100-byte string is cut; documents with nothing left go."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    cut = suffix_dedup.remove_repeats(rows, text="row.text", id_col="row.doc_id").filter("n_removed < n_bytes OR n_bytes = 0")
    # A cut may fall inside a character; what is left of that character goes too.
    left = F.when(F.is_valid_utf8(F.col("kept").cast("string")), F.col("kept").cast("string")) \
        .otherwise(F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("�"), F.lit("")))
    return _with_text(cut.withColumn("left", F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(left)), docs.columns)


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``row`` with the text of ``left`` and its length."""
    new = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    clean = secret_scan.redact(docs, secret_scan.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences filled with lexical neighbours."""
    rows = packing.pack(docs, tokenizer_path())
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("suffix-array dedup", repeated_passages_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

# Near-duplicate classes, the forest's verdicts and the packing have no SQL form; tests/llm
# holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
