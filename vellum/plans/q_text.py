"""Registered text-function queries (section 2.2): every row of the text tables, whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import tokens as TK
from vellum.operators import textops as TO
from vellum.plans import sqlgen as S
from vellum.plans.inputs import table
from vellum.plans.registry import register


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


# Hashtag input built from the documents: a CamelCase tag from lang + source, and every
# sentence-initial capitalised word turned into a tag.
def _tagged(col_text, col_lang, col_source):
    tagged = F.regexp_replace(col_text, r"([.!?]) (\p{Lu})", "$1 #$2")
    return F.concat(F.lit("#"), F.initcap(col_lang), F.initcap(col_source), F.lit(" "), tagged)


_TAGGED_SQL = ("'#' || upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) || upper(substr(source, 1, 1)) "
               "|| lower(substr(source, 2)) || ' ' || " + S.rx("text", r"([.!?]) (\p{Lu})", "\\1 #\\2"))


def _social(col_text, col_lang, col_source, col_id):
    return F.concat(F.lit("@"), col_source, F.lit(" "), _tagged(col_text, col_lang, col_source),
                    F.lit(" http://x.example/"), col_id.cast("string"), F.lit(" www.example.org/a"))


_SOCIAL_SQL = (f"'@' || source || ' ' || {_TAGGED_SQL} || ' http://x.example/' || CAST(doc_id AS VARCHAR) "
               f"|| ' www.example.org/a'")


def _sql_strip_mentions(e):
    return S.rx(e, "@" + T.WORD + "+", "")


def _sql_strip_urls(e):
    return S.rx(e, "http" + T.NON_WS + "+|www[^\\n]" + T.NON_WS + "+", "")


def _sql_segment_hashtags(e):
    pieces = f"regexp_extract_all({e}, {S.q('(#' + T.WORD + '+|[^#]+|#)')}, 1)"
    fix = (f"CASE WHEN starts_with(p, '#') AND length(p) > 1 THEN array_to_string("
           f"regexp_extract_all(substr(p, 2), {S.q('[A-Z][a-z]+|' + T.WORD + '+')}), ' ') ELSE p END")
    return f"array_to_string(list_transform({pieces}, lambda p: {fix}), '')"


def _sql_clean_social(e):
    return S.collapse_ws(S.strip_html(_sql_segment_hashtags(_sql_strip_urls(_sql_strip_mentions(e)))))


@register("strip_mentions", f"SELECT doc_id, {_sql_strip_mentions('text')} AS out FROM documents")
def q_strip_mentions(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.strip_mentions("text").alias("out"))


@register("strip_urls", f"SELECT page_id, {_sql_strip_urls("concat_ws(' ', url, html)")} AS out FROM pages")
def q_strip_urls(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("page_id", T.strip_urls(F.concat_ws(" ", "url", "html")).alias("out"))


@register("segment_hashtags", f"SELECT doc_id, {_sql_segment_hashtags(_TAGGED_SQL)} AS out FROM documents")
def q_segment_hashtags(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.segment_hashtags(_tagged(F.col("text"), F.col("lang"), F.col("source"))).alias("out"))


@register("strip_html", f"SELECT page_id, {S.strip_html('html')} AS out FROM pages")
def q_strip_html(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", T.strip_html("html").alias("out"))


@register("collapse_whitespace", f"SELECT doc_id, {S.collapse_ws('text')} AS out FROM documents")
def q_collapse_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.collapse_whitespace("text").alias("out"))


@register("clean_social_text", f"SELECT doc_id, {_sql_clean_social(_SOCIAL_SQL)} AS out FROM documents")
def q_clean_social(spark, sf_dir):
    d = _docs(spark, sf_dir)
    src = _social(F.col("text"), F.col("lang"), F.col("source"), F.col("doc_id"))
    return d.select("doc_id", T.clean_social(src).alias("out"))


@register("clean_markup_text", f"SELECT page_id, {S.clean_markup('html')} AS out FROM pages")
def q_clean_markup(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", T.clean_markup("html").alias("out"))


@register("word_tokens", f"""
SELECT doc_id, token, count(*) AS n
FROM (SELECT doc_id, unnest({S.word_tokens('text')}) AS token FROM documents)
GROUP BY doc_id, token""")
def q_word_tokens(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return TK.term_counts(d, T.word_tokens("text"), ("doc_id",), "token")


@register("filter_tokens", f"""
SELECT doc_id, token, count(*) AS n
FROM (SELECT doc_id, unnest(list_filter({S.word_tokens('text')}, lambda x: regexp_full_match(x, '\\p{{L}}+')
      AND NOT list_contains({S.stop_array(False)}, x))) AS token FROM documents)
GROUP BY doc_id, token""")
def q_filter_tokens(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return TK.term_counts(d, T.filter_tokens(T.word_tokens("text")), ("doc_id",), "token")


@register("preprocess_corpus", f"""
SELECT doc_id, array_to_string({S.filtered_tokens('text', extra=True)}, ' ') AS processed FROM documents""")
def q_preprocess(spark, sf_dir):
    return TK.preprocess_corpus(_docs(spark, sf_dir), "text").select("doc_id", "processed")


def _sql_truncate(e, k):
    s = S.rx(e, "^" + T.WS + "+|" + T.WS + "+$", "")
    toks = f"regexp_split_to_array({s}, {S.q(T.WS + '+')})"
    n = f"CASE WHEN length({s}) = 0 THEN 0 ELSE len({toks}) END"
    head = f"array_to_string(list_slice({toks}, 1, {k}), ' ')"
    return f"CASE WHEN {n} > {k} THEN {head} || '...' ELSE {head} END"


@register("truncate_words", f"""
SELECT doc_id, {_sql_truncate('text', 48)} AS text48, {_sql_truncate('text', 16)} AS text16 FROM documents""")
def q_truncate(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.truncate_words("text", 48).alias("text48"), T.truncate_words("text", 16).alias("text16"))


_SP_SQL = ("array_to_string(list_transform(range(0, CAST(ceil(len(parts) / 2) AS BIGINT)), "
           "lambda i: array_to_string(list_slice(parts, 2 * i + 1, 2 * i + 2), ' ')), '<br>')")


@register("sentence_pairs", f"""
SELECT doc_id, {_SP_SQL} AS out
FROM (SELECT doc_id, string_split({S.rx('text', '([.!?]) +', chr(92) + '1' + chr(1))}, chr(1)) AS parts FROM documents)""")
def q_sentence_pairs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.sentence_pairs("text").alias("out"))


@register("coords_codec", """
SELECT vec_id, pos, CAST(round(CAST(CAST(v AS VARCHAR) AS DECIMAL(20, 10)), 6) AS DOUBLE) AS value
FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings)""")
def q_coords_codec(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    enc = e.select("vec_id", T.encode_coords("embedding").alias("s"))
    dec = enc.select("vec_id", F.posexplode(T.decode_coords("s")).alias("pos", "v"))
    return dec.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("value"))


CHUNK_L = 128


def _sql_chunks(mode):
    toks = f"regexp_split_to_array({S.collapse_ws('text')}, ' ')"
    base = f"SELECT doc_id, {S.collapse_ws('text')} AS s, {toks} AS t FROM documents"
    n = "CASE WHEN length(s) = 0 THEN 0 ELSE len(t) END"
    L = CHUNK_L
    if mode == "classic":
        return f"SELECT doc_id, 0 AS chunk_no, s AS chunk_text FROM ({base})"
    if mode == "longform":
        return (f"SELECT doc_id, chunk_no, CASE WHEN {n} > {L} THEN array_to_string(list_slice(t, chunk_no * {L} + 1, "
                f"chunk_no * {L} + {L}), ' ') ELSE s END AS chunk_text FROM ({base}), "
                f"unnest(range(0, CASE WHEN {n} > {L} THEN CAST(ceil({n} / {L}) AS BIGINT) ELSE 1 END)) AS u(chunk_no)")
    h = L // 2
    return (f"SELECT doc_id, chunk_no, CASE WHEN {n} > {L} THEN (CASE WHEN chunk_no = 0 THEN "
            f"array_to_string(list_slice(t, 1, {h}), ' ') ELSE array_to_string(list_slice(t, len(t) - {h} + 1, len(t)), ' ') END)"
            f" ELSE s END AS chunk_text FROM ({base}), "
            f"unnest(range(0, CASE WHEN {n} > {L} THEN 2 ELSE 1 END)) AS u(chunk_no)")


@register("chunk_tokens", " UNION ALL ".join(
    f"SELECT '{m}' AS mode, doc_id, chunk_no, chunk_text FROM ({_sql_chunks(m)})" for m in ("classic", "longform", "snapshot")))
def q_chunk_tokens(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.collapse_whitespace("text").alias("s"))
    parts = [TO.chunk_tokens(d, m, CHUNK_L, "s").select(F.lit(m).alias("mode"), "doc_id",
                                                        F.col("chunk_no").cast("long").alias("chunk_no"), "chunk_text")
             for m in ("classic", "longform", "snapshot")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("count_chunks", " UNION ALL ".join(
    f"SELECT '{m}' AS mode, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks FROM ({_sql_chunks(m)})"
    for m in ("classic", "longform", "snapshot")))
def q_count_chunks(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.collapse_whitespace("text").alias("s"))
    parts = [TO.count_chunks(d, m, CHUNK_L, "s").select(F.lit(m).alias("mode"), "n_docs", "n_chunks")
             for m in ("classic", "longform", "snapshot")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- fixed values: emoji alias table used by the checked query (a user-supplied table
# in general); the emoji are attached to the documents by language below.
EMOJI_ALIASES = {"👍": "thumbs_up", "😀": "grinning_face", "❤": "red_heart", "🎉": "party_popper"}
_LANG_EMOJI = {"en": "👍", "fr": "❤", "de": "😀", "es": "🎉"}


def _with_emoji(col_text, col_lang):
    e = F.coalesce(*[F.when(col_lang == k, F.lit(v)) for k, v in _LANG_EMOJI.items()], F.lit(""))
    return F.concat(e, F.lit(" "), col_text, F.lit(" "), e, e)


_EMOJI_SQL_IN = ("(CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LANG_EMOJI.items()) + " ELSE '' END)")
_EMOJI_SRC_SQL = f"{_EMOJI_SQL_IN} || ' ' || text || ' ' || {_EMOJI_SQL_IN} || {_EMOJI_SQL_IN}"


def _sql_replace_emojis(e):
    for k in sorted(EMOJI_ALIASES, key=len, reverse=True):
        e = f"replace({e}, '{k}', ':{EMOJI_ALIASES[k]}:')"
    return e


@register("replace_emojis", f"SELECT doc_id, {_sql_replace_emojis(_EMOJI_SRC_SQL)} AS out FROM documents")
def q_replace_emojis(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.replace_emojis(_with_emoji(F.col("text"), F.col("lang")), EMOJI_ALIASES).alias("out"))
