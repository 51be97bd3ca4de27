"""Wide ↔ long prediction tables and metadata parsing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PROB = re.compile(r"probability\s+distribution", re.I)
_CONT = re.compile(r"continuous\s*:", re.I)


def pivot_predictions(long: DataFrame, labels: list[str] | None = None, value_col: str = "prob",
                      n_outputs: int | None = None) -> DataFrame:
    """Class probabilities → ``Probability Distribution i: label`` columns, numbered from 1
    (``continuous: label`` when there is one output). Labels default to ``Class_i``.

    Scored rows with a ``probs`` array already hold a document's columns and are read off
    without a shuffle; a long table ``(doc_id, class_no, prob)`` is pivoted over explicit
    values, so Spark does not run a distinct job first.
    """
    k = n_outputs or (len(labels) if labels else None)
    if k is None:
        raise ValueError("pass labels or n_outputs")
    names = [labels[i] if labels else f"Class_{i + 1}" for i in range(k)]
    out = [f"Probability Distribution {i + 1}: {names[i]}" for i in range(k)] if k > 1 else [f"continuous: {names[0]}"]
    if "probs" in long.columns:
        return long.select("doc_id", *[F.col("probs")[i].alias(out[i]) for i in range(k)])
    if k == 1:
        return long.groupBy("doc_id").agg(F.first(value_col).alias(out[0]))
    wide = long.groupBy("doc_id").pivot("class_no", list(range(k))).agg(F.first(value_col))
    return wide.select("doc_id", *[F.col(f"`{i}`").alias(out[i]) for i in range(k)])


def prediction_columns(columns: list[str], base=("text", "source", "time", "doc_id")) -> list[tuple[str, str, int | None, str]]:
    """Parse column names into (column, type, number, word); base columns are matched
    ignoring case and outer spaces and skipped."""
    out = []
    base_l = {b.strip().lower() for b in base}
    for c in columns:
        if c.strip().lower() in base_l:
            continue
        if _CONT.search(c):
            out.append((c, "continuous", None, c[_CONT.search(c).end():].strip()))
        elif _PROB.search(c):
            m = re.search(r"(\d+)\s*:\s*(.*)$", c)
            out.append((c, "probability distribution", int(m.group(1)) if m else None,
                        m.group(2).strip() if m else c))
        else:
            out.append((c, "unknown", None, c))
    return out


def melt_predictions(df: DataFrame, id_cols=("doc_id",), base=("text", "source", "time")) -> DataFrame:
    """Wide prediction columns → long ``(id…, column_name, pred_type, number, word, value)``.

    The column list comes from the schema (driver metadata); the rows are unpivoted by
    Spark's ``unpivot`` (an ``Expand``, no shuffle).
    """
    parsed = [p for p in prediction_columns(df.columns, tuple(base) + tuple(id_cols)) if p[1] != "unknown"]
    if not parsed:
        return df.sparkSession.createDataFrame([], "column_name string, value double")
    cols = [p[0] for p in parsed]
    long = df.select(*id_cols, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(
        list(id_cols), cols, "column_name", "value")
    meta = df.sparkSession.createDataFrame(parsed, "column_name string, pred_type string, number int, word string")
    return long.join(F.broadcast(meta), "column_name")   # one row per prediction column


def metadata_to_map(df: DataFrame, col: str = "Metadata", order_col: str = "doc_id") -> DataFrame:
    """Parse ``key: value`` / ``key = value`` lines of all metadata cells into ``(key, value)``.

    Lines equal to ``metadata`` (any case) are skipped; the first ``:`` splits, else the
    first ``=``; keys are lower-cased and trimmed; a later cell (by ``order_col``, then
    line number) wins for duplicate keys. ``max_by`` is a plain aggregate, so a hot key
    is combined map-side.
    """
    lines = df.filter(F.col(col).isNotNull()).select(
        order_col, F.posexplode(F.split(F.trim(F.col(col)), "\n")).alias("line_no", "line"))
    lines = lines.filter((F.lower("line") != "metadata") & (F.col("line").contains(":") | F.col("line").contains("=")))
    has_colon = F.col("line").contains(":")
    key = F.when(has_colon, F.substring_index("line", ":", 1)).otherwise(F.substring_index("line", "=", 1))
    val = F.when(has_colon, F.expr("substr(line, instr(line, ':') + 1)")).otherwise(F.expr("substr(line, instr(line, '=') + 1)"))
    kv = lines.select(F.lower(F.trim(key)).alias("key"), F.trim(val).alias("value"),
                      F.struct(order_col, "line_no").alias("ord"))
    return kv.groupBy("key").agg(F.max_by("value", "ord").alias("value"))
