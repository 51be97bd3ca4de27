"""Maps the driver's tables onto the document model (``doc_id, Text, Source, Time``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIME_FMT = "yyyy-MM-dd HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables.

    A file of one row group is read by one task, whatever its size, so a scan with fewer
    partitions than the session has cores is dealt out evenly (round robin). No key is
    involved: operators plan the same joins, aggregates and exchanges above either scan.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(2 * cores)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, Text, Source, Time, lang)``: documents, with the event time of the same id
    as the document time (NULL when there is none)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("Text"), F.col("source").alias("Source"), "lang")
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), F.date_format("ts", TIME_FMT).alias("Time"))
    return docs.join(ev, "doc_id", "left")
