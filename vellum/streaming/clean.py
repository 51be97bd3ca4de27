"""Cleaning and tokenising a document stream with Structured Streaming.

The reference has no streaming; the column functions are stateless, so the same
expressions apply unchanged to a streaming DataFrame. The sink commits through a
checkpoint folder, so a restarted query resumes after its last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import tokens as TK


def clean_columns(df: DataFrame, text_col: str = "text", social: bool = True) -> DataFrame:
    """Add ``clean`` (social or mark-up cleaning) and ``tokens`` (filtered word tokens)."""
    clean = T.clean_social(text_col) if social else T.clean_markup(text_col)
    return df.withColumn("clean", clean).withColumn("tokens", TK.filtered_tokens(F.col(text_col)))


def start_clean_stream(spark: SparkSession, src_dir: str, schema: str, sink_dir: str, checkpoint_dir: str,
                       text_col: str = "text", trigger_once: bool = True):
    """parquet files arriving in ``src_dir`` → cleaned rows appended to ``sink_dir``."""
    stream = spark.readStream.schema(schema).parquet(src_dir)
    w = (clean_columns(stream, text_col).writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
