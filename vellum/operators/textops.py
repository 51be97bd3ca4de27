"""Table-level text operators: chunking, fixed-length encoding, label mapping, time
parsing, hover text, prediction melt/pivot, metadata parsing, lemmatising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.ranking import global_index


# ---------------------------------------------------------------- chunks
def _chunk_parts(s: Column, toks: Column, mode: str, L: int):
    n = F.when(F.length(s) == 0, F.lit(0)).otherwise(F.size(toks))
    if mode == "classic":
        return F.array(s), n
    if mode == "longform":
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / F.lit(L)).cast("int") - 1),
                             lambda i: F.array_join(F.slice(toks, i * L + 1, L), " "))
        return F.when(n > L, blocks).otherwise(F.array(s)), n
    if mode == "snapshot":
        h = L // 2
        ends = F.array(F.array_join(F.slice(toks, 1, h), " "),
                       F.array_join(F.slice(toks, F.greatest(n - h + 1, F.lit(1)), h), " "))
        return F.when(n > L, ends).otherwise(F.array(s)), n
    raise ValueError(f"unknown chunk mode {mode!r}")


def chunk_tokens(df: DataFrame, mode: str = "classic", L: int = 128, text_col: str = "Text",
                 id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, chunk_no, chunk_text)`` over whitespace tokens of an already cleaned text.

    classic: the text; longform: blocks of L tokens when longer than L; snapshot: first
    and last L//2 tokens when longer than L. Per-row array work, no shuffle.
    """
    from vellum.operators.tokens import explode_values
    # The tokens are a column: an expression would be evaluated again for every chunk.
    df = df.withColumn("_toks", F.split(text_col, " "))
    parts, _ = _chunk_parts(F.col(text_col), F.col("_toks"), mode, L)
    return explode_values(df, [id_col], parts, "chunk_text", "chunk_no")


def count_chunks(df: DataFrame, mode: str = "classic", L: int = 128, text_col: str = "Text",
                 id_col: str = "doc_id", per_doc: bool = False) -> DataFrame:
    """Chunks per document (``ceil(n/L)``, 2 or 1) and, unless ``per_doc``, the totals."""
    toks = F.split(F.col(text_col), " ")
    n = F.when(F.length(text_col) == 0, F.lit(0)).otherwise(F.size(toks))
    if mode == "longform":
        k = F.when(n > L, F.ceil(n / F.lit(L))).otherwise(F.lit(1))
    elif mode == "snapshot":
        k = F.when(n > L, F.lit(2)).otherwise(F.lit(1))
    else:
        k = F.lit(1)
    per = df.select(id_col, k.cast("long").alias("n_chunks"))
    if per_doc:
        return per
    return per.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chunks").cast("long").alias("n_chunks"))


def unmapped_labels(df: DataFrame, label_col: str, mapping: dict) -> int:
    """Number of rows whose label the mapping does not cover (non-strict mode report)."""
    return map_labels(df, label_col, mapping, strict=False, out_col="_m").filter(
        F.col("_m").isNull() & F.col(label_col).isNotNull()).count()


def prepare_training_table(df: DataFrame, cfg: dict, mapping: dict | None = None, vocab: DataFrame | None = None, n: int | None = None,
                           train_share: int = 80, seed: int = 42, max_len: int = 128, id_col: str = "doc_id") -> DataFrame:
    """A table ready for training: ``doc_id, label, split, clean_text[, input_ids, attention_mask]``.

    Takes the text (and label) column named by the configuration, a sample of ``n`` rows if
    asked for, the table's own ``split`` or one by key hash, cleans the text, maps the labels,
    and encodes to ids with a mask where a vocabulary is given.
    """
    from vellum.functions import text as T
    from vellum.operators import tokens as TK
    from vellum.sources import documents as SD
    text, label = cfg["text_field"], cfg.get("label_field") or "label"
    rows = SD.sample_documents(df, n, True, seed, id_col)
    rows = rows if "split" in rows.columns else SD.split_documents(rows, train_share, id_col)
    out = map_labels(rows, label, mapping).select(F.col(id_col).alias("doc_id"), F.col("label").cast("int").alias("label"), "split",
                                                  T.clean_social(text).alias("clean_text"))
    if vocab is None:
        return out
    return out.join(encode_fixed_length(TK.with_tokens(out, "clean_text"), vocab, max_len), "doc_id")


# ---------------------------------------------------------------- encoding
def encode_fixed_length(tokens: DataFrame, vocab: DataFrame, max_len: int = 128,
                        token_col: str = "tokens", id_col: str = "doc_id") -> DataFrame:
    """Token ids truncated / padded to ``max_len`` plus a 0/1 attention mask (pad id 0).

    Ids are ``token_id + 1`` of the vocabulary; only the first ``max_len`` positions are
    exploded and joined, so the per-document regroup is bounded by ``max_len``.
    """
    from vellum.operators.tokens import explode_values
    rows = explode_values(tokens, [id_col], F.slice(token_col, 1, max_len), "term", "pos")
    ids = (rows.join(vocab.select("term", (F.col("token_id") + 1).cast("int").alias("tid")), "term", "left")
               .groupBy(id_col)
               .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("tid", F.lit(0)).alias("tid")))).alias("e")))
    base = tokens.select(id_col).join(ids, id_col, "left")
    got = F.coalesce(F.transform("e", lambda x: x["tid"]), F.array().cast("array<int>"))
    pad = F.array_repeat(F.lit(0), F.lit(max_len) - F.size(got))
    return base.select(id_col, F.concat(got, pad).alias("input_ids"),
                       F.concat(F.array_repeat(F.lit(1), F.size(got)), pad).alias("attention_mask"))


# ---------------------------------------------------------------- labels
def map_labels(df: DataFrame, label_col: str, mapping: dict | None, strict: bool = True,
               out_col: str = "label") -> DataFrame:
    """Label → class id: the string form of the label first, then its integer form.

    Empty mapping → labels pass through. Unmapped labels raise (strict) or give NULL.
    The mapping is a small literal map (its size is the class count).
    """
    if not mapping:
        return df.withColumn(out_col, F.col(label_col))
    str_keys = {str(k): int(v) for k, v in mapping.items()}
    m = F.create_map(*[x for k, v in str_keys.items() for x in (F.lit(k), F.lit(v))])
    lab = F.col(label_col).cast("string")
    as_int = F.regexp_replace(lab, r"\.0+$", "")
    by_str = F.try_element_at(m, lab)
    by_int = F.try_element_at(m, as_int)
    mapped = F.coalesce(by_str, by_int)
    if strict:
        mapped = F.when(mapped.isNull(), F.raise_error(F.concat(F.lit("the mapping has no class for label "),
                                                                 F.coalesce(lab, F.lit("null")))).cast("int")
                        ).otherwise(mapped)
    return df.withColumn(out_col, mapped)


# ---------------------------------------------------------------- lemmatising
# --- fixed values: noun suffix rules (suffix, replacement), tried on every token ----
NOUN_SUFFIX_RULES = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
                     ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))


def lemmatise(tokens: DataFrame, vocab: DataFrame, exceptions: DataFrame | None = None,
              token_col: str = "token", term_col: str = "term") -> DataFrame:
    """``(token, lemma)`` for distinct lower-case alphabetic tokens.

    Candidates are the token and its suffix-rule rewrites; a candidate is valid when it is
    in the vocabulary; the shortest valid candidate wins (ties: alphabetical); no valid
    candidate → the token itself. An ``exceptions`` table ``(token, lemma)`` overrides.
    Work is on the distinct-token table (vocabulary-sized) with a semi-join, and the
    result is meant to be broadcast back onto token rows.
    """
    t = F.col(token_col)
    cands = [t] + [F.when(t.endswith(suf) & (F.length(t) > len(suf)),
                          F.concat(F.expr(f"substring({token_col}, 1, length({token_col}) - {len(suf)})"), F.lit(rep)))
                   for suf, rep in NOUN_SUFFIX_RULES]
    distinct = tokens.select(token_col).distinct()
    c = distinct.select(token_col, F.explode(F.array(*cands)).alias("cand")).filter(F.col("cand").isNotNull())
    valid = c.join(vocab.select(F.col(term_col).alias("cand")).distinct(), "cand", "left_semi")
    best = valid.groupBy(token_col).agg(F.min_by("cand", F.struct(F.length("cand"), F.col("cand"))).alias("lemma"))
    out = distinct.join(best, token_col, "left").select(token_col, F.coalesce("lemma", F.col(token_col)).alias("lemma"))
    if exceptions is not None:
        out = (out.join(exceptions.select(token_col, F.col("lemma").alias("exc")), token_col, "left")
                  .select(token_col, F.coalesce("exc", "lemma").alias("lemma")))
    return out
