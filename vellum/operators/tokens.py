"""Token tables: arrays per document and exploded (doc, position, token) rows."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import packed as P


def bigrams(tokens) -> Column:
    """Adjacent pairs of an ``array<string>`` joined by one space."""
    t = T._c(tokens)
    pairs = F.zip_with(t, F.slice(t, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def ngrams(tokens, n_min: int = 1, n_max: int = 2) -> Column:
    """Uni- and/or bi-grams of a token array, unigrams first (as a count vectoriser emits)."""
    t = T._c(tokens)
    parts = []
    if n_min <= 1 <= n_max:
        parts.append(t)
    if n_min <= 2 <= n_max:
        parts.append(bigrams(t))
    if not parts or n_max > 2:
        raise ValueError("only 1- and 2-grams are supported")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def filtered_tokens(text_col, extra: bool = False, mode: str = "words") -> Column:
    """clean mark-up → word tokens → alphabetic, non-stop tokens (array column)."""
    return T.filter_tokens(T.word_tokens(T.clean_markup(text_col), mode, cleaned=True), extra=extra)


def counted_tokens(text_col, extra: bool = False) -> Column:
    """The distinct terms of :func:`filtered_tokens` and their counts, packed (:func:`packed.counted_words`),
    without an array of all tokens."""
    return P.counted_words(T.token_text(T.clean_markup(text_col), cleaned=True), T.ALPHA_ONLY, T.stop_list(extra))


def shared_counts(df: DataFrame, terms: str, share: float, n: int, group_cols=("doc_id",)) -> tuple[DataFrame, pa.Array] | None:
    """(packed counts, vocabulary) of every row of ``df`` for the terms that may stand in ``share`` of its ``n`` rows, and some more.

    Such terms are at most (terms of a mean document) / ``share``; their places in the sorted vocabulary stand
    for them. None if the vocabulary is beyond :data:`packed.PLACED_ROWS` or the share is none.
    """
    if not n or share * n <= 1:
        return None
    found = P.small_table(P.candidates(df, terms, share), P.PLACED_ROWS)
    if found is None:
        return None
    vocab = P.terms_of(found)
    vocab = vocab.take(pc.sort_indices(vocab))
    return df.select(*group_cols, P.counted_places(terms, vocab).alias("_c")).select(*group_cols, "_c.term", "_c.n"), vocab


def with_tokens(df: DataFrame, text_col: str = "Text", extra: bool = False,
                out_col: str = "tokens") -> DataFrame:
    """Add the filtered token array as a column, so later expressions that use it
    several times (n-grams) reference the column instead of re-tokenising."""
    return df.withColumn(out_col, filtered_tokens(text_col, extra=extra))


def preprocess_corpus(df: DataFrame, text_col: str = "Text", join: bool = True,
                      use_tokenization: bool = True, extra: bool = True,
                      out_col: str = "processed") -> DataFrame:
    """clean → tokens → filter → space-joined string (or array); tokenising off → cleaned text."""
    if not use_tokenization:
        return df.withColumn(out_col, T.clean_markup(text_col))
    toks = filtered_tokens(text_col, extra=extra)
    return df.withColumn(out_col, F.array_join(toks, " ") if join else toks)


def explode_values(df: DataFrame, keep, arr, alias: str, pos_alias: str | None = None) -> DataFrame:
    """Explode an array column into rows, skipping empty arrays.

    Written as ``explode_outer`` + a null filter on purpose: for a plain ``explode``
    Catalyst infers ``size(arr) > 0`` and pushes it to the scan, which evaluates an
    expensive array expression (the whole tokeniser) twice — once below any
    repartition, i.e. before the work is spread over the cores.
    """
    keep = [F.col(c) if isinstance(c, str) else c for c in keep]
    if pos_alias:
        out = df.select(*keep, F.posexplode_outer(arr).alias(pos_alias, alias))
        return out.filter(F.col(pos_alias).isNotNull())
    return df.select(*keep, F.explode_outer(arr).alias(alias)).filter(F.col(alias).isNotNull())


def term_counts(df: DataFrame, terms, group_cols=("doc_id",), term_col: str = "term") -> DataFrame:
    """``(*group_cols, term, n)`` for every row of ``df``: its terms and how often each occurs.

    Counted inside the row (sort the array, cut it into runs), so a document's counts need
    no shuffle, however the table is stored. ``df`` has one row per document.
    """
    rows = df.select(*group_cols, F.array_sort(T._c(terms)).alias("_sorted"))
    i = F.sequence(F.lit(1), F.size("_sorted"))
    first = F.filter(i, lambda k: (k == 1) | (F.element_at("_sorted", k) != F.element_at("_sorted", F.greatest(k - 1, F.lit(1)))))
    rows = rows.select(*group_cols, "_sorted", F.when(F.size("_sorted") > 0, first).alias("_first"))
    ends = F.concat(F.slice("_first", 2, F.size("_first")), F.array(F.size("_sorted") + 1))
    runs = F.zip_with("_first", ends, lambda a, b: F.struct(F.element_at("_sorted", a).alias(term_col), (b - a).cast("long").alias("n")))
    return explode_values(rows, list(group_cols), runs, "_run").select(*group_cols, f"_run.{term_col}", "_run.n")
