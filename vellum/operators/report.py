"""Report tables behind the figures: top/bottom lists, class histogram, series, counts,
hover text, time parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

WEEKDAY = r"^\s*(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
# Formats tried in order after a leading weekday name is removed (``EEE`` cannot be used in
# a Spark 4 parse pattern), commas are dropped and white space is collapsed. Ambiguous
# numeric dates are read month first; day first is tried where that fails.
DEFAULT_TIME_FORMATS = (
    "yyyy-M-d['T'][ ]H:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S][XXX][XX][X][ z]", "yyyy-M-d['T'][ ]H:mm[XXX][X][ z]", "yyyy-M-d", "yyyy-M", "yyyy/M/d[ H:mm[:ss]]", "yyyyMMdd['T'HHmmss]",
    "MMM d H:mm:ss[ z] yyyy", "MMM d yyyy[ H:mm[:ss]]", "MMMM d yyyy[ H:mm[:ss]]", "d MMM yyyy[ H:mm[:ss]][ z][ XX]", "d MMMM yyyy[ H:mm[:ss]]", "MMM yyyy", "MMMM yyyy",
    "M/d/yyyy[ H:mm[:ss]]", "M/d/yyyy h:mm[:ss] a", "d/M/yyyy[ H:mm[:ss]]", "M-d-yyyy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]")

# Fixed values: ``%`` directives and the pattern letters that read the same field.
_DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%H": "H", "%I": "h", "%M": "m", "%S": "s", "%f": "SSSSSS", "%p": "a",
               "%b": "MMM", "%B": "MMMM", "%j": "D", "%z": "XX", "%Z": "z", "%%": "%", "%T": "H:m:s", "%F": "yyyy-M-d", "%D": "M/d/yy"}


def spark_pattern(fmt: str) -> str:
    """A ``%``-style time format as a Spark pattern (a Spark pattern is returned as it is);
    weekday names, which carry no date, are left out."""
    if "%" not in fmt:
        return fmt
    out, literal, i = "", "", 0
    while i < len(fmt):
        pair = fmt[i:i + 2]
        if pair in ("%a", "%A"):
            i += 2
            while i < len(fmt) and fmt[i] in ", ":
                i += 1
            continue
        if pair[0] == "%" and pair not in _DIRECTIVES:
            raise ValueError(f"no such time directive: {pair}")
        if pair[0] == "%" and pair != "%%":
            out += (f"'{literal}'" if literal.isalpha() else literal) + _DIRECTIVES[pair]
            literal, i = "", i + 2
        else:
            step = 2 if pair == "%%" else 1
            letter = fmt[i]
            if literal and literal.isalpha() != letter.isalpha():
                out, literal = out + (f"'{literal}'" if literal.isalpha() else literal), ""
            literal += letter
            i += step
    return out + (f"'{literal}'" if literal.isalpha() else literal)


def parse_time_col(col, formats=None, custom: str | None = None) -> Column:
    """String → timestamp: the custom format alone when given (Spark or ``%`` style), else the
    first of the known formats that parses; failures are NULL (``try_to_timestamp``, ANSI-safe)."""
    s = F.trim(F.regexp_replace(T._c(col).cast("string"), WEEKDAY, ""))
    if custom:
        return F.try_to_timestamp(s, F.lit(spark_pattern(custom)))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, ",", " "), r"\s+", " "))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in (formats or DEFAULT_TIME_FORMATS)])


def parse_time(df: DataFrame, col: str = "Time", out_col: str = "Parsed_Time", formats=None,
               custom: str | None = None, drop: bool = False) -> DataFrame:
    out = df.withColumn(out_col, parse_time_col(col, formats, custom))
    return out.filter(F.col(out_col).isNotNull()) if drop else out


def time_parse_report(parsed: DataFrame, out_col: str = "Parsed_Time") -> DataFrame:
    return parsed.agg(F.count_if(F.col(out_col).isNotNull()).alias("n_parsed"),
                      F.count_if(F.col(out_col).isNull()).alias("n_unparsed"))


def top_bottom(long: DataFrame, n: int = 10, key_col: str = "column_name", score_col: str = "score",
               id_col: str = "doc_id", nulls_as_lowest: bool = False) -> DataFrame:
    """Per prediction column the ``n`` highest and ``n`` lowest rows, ``Category`` =
    ``Top Scores`` / ``Lowest Scores``. Both blocks are per-column windows with a row
    limit, planned as ``WindowGroupLimit`` (n rows per task and column before the shuffle).
    Overlap is kept when a column has fewer than 2n rows."""
    src = long if nulls_as_lowest else long.filter(F.col(score_col).isNotNull())
    top_w = Window.partitionBy(key_col).orderBy(F.col(score_col).desc_nulls_last(), F.col(id_col).asc())
    low_w = Window.partitionBy(key_col).orderBy(F.col(score_col).asc_nulls_first(), F.col(id_col).desc())
    top = (src.withColumn("_r", F.row_number().over(top_w)).filter(F.col("_r") <= n)
              .withColumn("Category", F.lit("Top Scores")))
    low = (src.withColumn("_r", F.row_number().over(low_w)).filter(F.col("_r") <= n)
              .withColumn("Category", F.lit("Lowest Scores")))
    return top.unionByName(low).drop("_r")


def top_bottom_table(wide: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str | None = "Text",
                     nulls_as_lowest: bool = False) -> DataFrame:
    """Top/bottom rows for every prediction column of a wide table, with the text cut to
    48 words. With exactly two probability columns only the first is reported (the
    second is its complement). Columns are found from the schema (driver metadata)."""
    from vellum.operators.tables import melt_predictions, prediction_columns
    base = (id_col,) + ((text_col,) if text_col else ())
    probs = [c for c, t, _, _ in prediction_columns(wide.columns, base) if t == "probability distribution"]
    src = wide.drop(probs[1]) if len(probs) == 2 else wide
    long = melt_predictions(src.drop(text_col) if text_col else src, id_cols=[id_col]).select(
        id_col, "column_name", F.col("value").alias("score"))
    out = top_bottom(long, n, "column_name", "score", id_col, nulls_as_lowest)
    if text_col:
        # The ranked rows are few (2n per column), so they go to the texts, not the texts to them.
        texts = wide.select(id_col, text_col).join(F.broadcast(out.select(id_col).distinct()), id_col, "left_semi")
        out = out.join(texts.select(id_col, T.truncate_words(text_col, 48).alias(text_col)), id_col, "left")
    return out


def class_histogram(preds: DataFrame, classes: DataFrame, pred_col: str = "pred") -> DataFrame:
    """Documents per highest-probability class; zero-count classes kept (classes is
    ``(class_no, class_name)``, one row per class)."""
    h = preds.filter(F.col(pred_col).isNotNull()).groupBy(F.col(pred_col).alias("class_no")).agg(
        F.count(F.lit(1)).alias("n"))
    return (classes.join(F.broadcast(h), "class_no", "left")
                   .select("class_no", "class_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
                   .orderBy(F.desc("n"), F.desc("class_name")))     # one row per class


def continuous_series(df: DataFrame, score_col: str, source_col: str = "Source", time_col: str = "Parsed_Time") -> DataFrame:
    """``(source, time, score)``; null scores dropped, missing source → ``Unknown``."""
    return df.filter(F.col(score_col).isNotNull()).select(
        F.coalesce(F.col(source_col), F.lit("Unknown")).alias("source"), F.col(time_col).alias("time"),
        F.col(score_col).alias("score"))


def expectation(probs: Column, n_classes: int) -> Column:
    """``E = Σ p_i·(i/n − 1/(2n))`` over classes 1…n; NULL when any probability is NULL."""
    mids = [i / n_classes - 1 / (2 * n_classes) for i in range(1, n_classes + 1)]
    terms = [probs[i] * F.lit(mids[i]) for i in range(n_classes)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def source_counts(df: DataFrame, source_col: str = "Source") -> DataFrame:
    """Rows per source plus a total row (``rollup``: source NULL → ``Total``)."""
    r = df.rollup(F.coalesce(F.col(source_col), F.lit("Unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return r.select(F.coalesce("source", F.lit("Total")).alias("source"), "n")


def hover_text(score: Column, time: Column, text: Column, topic: Column | None = None,
               words: Column | None = None, context: str = "Sentiment") -> Column:
    """Per-row hover string: score (empty if missing), date, 16-word text, then the topic note."""
    shown = F.when(score.isNull(), F.lit("")).otherwise(F.format_string("%.6f", score))
    base = F.concat(F.lit(f"{context} essence score: "), shown, F.lit("<br>Date: "),
                    F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit("")), F.lit("<br>Text: "),
                    T.truncate_words(text, 16), F.lit("<br>"))
    if topic is None:
        return base
    first5 = F.array_join(F.slice(F.split(F.regexp_replace(words, r"^\{|\}$", ""), ", "), 1, 5), ", ")
    note = (F.when(topic == -1, F.lit("Text identified as a topic outlier."))
             .when(topic.isNotNull() & words.isNotNull(), F.concat(F.lit("Topic "), topic.cast("string"), F.lit(": "), first5))
             .otherwise(F.lit("")))
    return F.concat(base, note)
