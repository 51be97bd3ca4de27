"""Column → Column text functions.

All patterns are Java regexes run by Spark's built-in ``regexp_*`` expressions, so the
work stays inside whole-stage codegen; no Python runs per row. Python's ``\\w``/``\\s``
are Unicode-aware while Java's are ASCII, so the classes below are spelled out with
Unicode properties. The same class strings are valid RE2, which the SQL oracle uses.

Every function here is stateless and therefore also valid on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
# Character classes equal to Python's Unicode ``\s`` and ``\w``.
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
NON_WS = r"[^\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
ALPHA_ONLY = r"^\p{L}+$"

# English stop words (the standard NLTK English list, 179 entries, in its usual order).
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those "
    "am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don don't should should've "
    "now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn "
    "hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Domain fragments added to the stop list by the topic pipeline.
EXTRA_STOP_WORDS = ("cid", "th", "rd", "ye", "tha", "nd", "ng", "ee", "aa", "ne", "oe", "te", "ei", "er")

# Word tokeniser: replacements applied in this order to lower-cased text, then split on
# one space (recipe A of the blueprint). (pattern, Java replacement, RE2 replacement)
TOKEN_STEPS = (
    (r"<[^>]+>", "", ""),
    (WS + "+", " ", " "),
    ("([,;:?!@#$%&()\\[\\]{}<>\"“”‘’«»…]|--)", " $1 ", " \\1 "),
    (r"\.( |$)", " . $1", " . \\1"),
    (r"n't( |$)", " n't$1", " n't\\1"),
    (r"'(s|m|d|ll|re|ve)( |$)", " '$1$2", " '\\1\\2"),
    (r"(^| )can(not)( |$)", "$1can $2$3", "\\1can \\2\\3"),
)
# --- end of fixed values ------------------------------------------------------------

# What a text must hold for a step of TOKEN_STEPS to change it (None: not tested).
_STEP_NEEDLES = ("<", None, None, ".", "n't", "'", "cannot")
# Runs of WS other than a single space, which stands for itself.
_WS_RUNS = " " + WS + "+|[" + WS[1:-1] + "&&[^ ]]" + WS + "*"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_mentions(col) -> Column:
    """Remove ``@word`` mentions."""
    return F.regexp_replace(_c(col), "@" + WORD + "+", "")


def strip_urls(col) -> Column:
    """Remove ``http…`` and ``www?…`` runs up to the next whitespace (the dot after
    ``www`` is any character but a newline, as in the original pattern)."""
    return F.regexp_replace(_c(col), "http" + NON_WS + "+|www[^\\n]" + NON_WS + "+", "")


def segment_hashtags(col) -> Column:
    """``#ClimateChangeNow`` → ``Climate Change Now``; ``#climateChange`` stays whole.

    The text is cut into hashtag / non-hashtag pieces, each hashtag body is re-split into
    capitalised words (else the rest of the word), and the pieces are glued back.
    """
    pieces = F.regexp_extract_all(_c(col), F.lit("(#" + WORD + "+|[^#]+|#)"), 1)

    def fix(p):
        body = F.substring(p, 2, 1 << 30)
        words = F.regexp_extract_all(body, F.lit("[A-Z][a-z]+|" + WORD + "+"), 0)
        return F.when(p.startswith("#") & (F.length(p) > 1), F.array_join(words, " ")).otherwise(p)

    return F.array_join(F.transform(pieces, fix), "")


def replace_emojis(col, aliases: dict[str, str]) -> Column:
    """Replace every emoji listed in ``aliases`` (emoji → name) by ``:name:``.

    One regex pass cuts the text into known-emoji pieces and runs of other characters;
    a map literal (size bounded by the alias table) rewrites the emoji pieces.
    """
    if not aliases:
        return _c(col)
    import re

    keys = sorted(aliases, key=len, reverse=True)
    alt = "|".join(re.escape(k) for k in keys)
    starts = "".join(sorted({re.escape(k[0]) for k in keys}))
    pattern = "((?s)" + alt + "|[^" + starts + "]+|.)"
    mapping = F.create_map(*[x for k in keys for x in (F.lit(k), F.lit(":" + aliases[k].strip(":") + ":"))])
    pieces = F.regexp_extract_all(_c(col), F.lit(pattern), 1)
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(mapping, p), p)), "")


def _replace_steps(col, steps) -> Column:
    """``regexp_replace`` for each ``(needle, pattern, replacement)``, in order.

    A step runs only on a text that holds its needle, a literal part of every match. The text
    passes the steps as the one element of an array, so that each is evaluated once.
    """
    def change(needle, pattern, repl):
        def run(x):
            new = F.regexp_replace(x, pattern, repl)
            return new if needle is None else F.when(x.contains(needle), new).otherwise(x)
        return run

    held = F.array(_c(col))
    for step in steps:
        held = F.transform(held, change(*step))
    return held[0]


def strip_html(col) -> Column:
    """Remove ``<…>`` tags."""
    return _replace_steps(col, [("<", "<[^>]+>", "")])


def collapse_whitespace(col) -> Column:
    """Runs of (Unicode) whitespace → one space, then trim."""
    return F.trim(F.regexp_replace(_c(col), _WS_RUNS, " "))


def clean_social(col, mentions: bool = True, urls: bool = True, hashtags: bool = True,
                 emojis: dict[str, str] | None = None) -> Column:
    """Social-media cleaning: mentions, URLs, hashtags, emojis, HTML, whitespace, in that order."""
    c = _c(col)
    if mentions:
        c = strip_mentions(c)
    if urls:
        c = strip_urls(c)
    if hashtags:
        c = segment_hashtags(c)
    if emojis:
        c = replace_emojis(c, emojis)
    return collapse_whitespace(strip_html(c))


def clean_markup(col) -> Column:
    """Mark-up cleaning for topic models: HTML strip + whitespace collapse; any type → string."""
    return collapse_whitespace(strip_html(_c(col).cast("string")))


def token_text(col, cleaned: bool = False) -> Column:
    """Lower-case and space-separate the word tokens (recipe A before the final split).

    ``cleaned=True`` (input already whitespace-collapsed by :func:`clean_markup`) skips
    the whitespace pass: it only merges runs of spaces, and the empty tokens such runs
    produce are dropped after the split anyway.
    """
    steps = [(needle, pattern, repl) for needle, (pattern, repl, _) in zip(_STEP_NEEDLES, TOKEN_STEPS, strict=True)]
    return _replace_steps(F.lower(_c(col)), [x for i, x in enumerate(steps) if not (cleaned and i == 1)])


def word_tokens(col, mode: str = "words", cleaned: bool = False) -> Column:
    """Lower-cased tokens as ``array<string>``.

    ``words``: punctuation separated, contractions split, hyphenated words / numbers /
    inner-dot abbreviations kept whole. ``simple``: whitespace split (the fallback).
    """
    if mode == "simple":
        s = F.regexp_replace(F.lower(_c(col)), "^" + WS + "+|" + WS + "+$", "")
        return F.filter(F.split(s, WS + "+"), lambda t: F.length(t) > 0)
    if mode != "words":
        raise ValueError(f"unknown tokeniser mode {mode!r}")
    return F.filter(F.split(token_text(col, cleaned), " "), lambda t: F.length(t) > 0)


def stop_list(extra: bool = False) -> list[str]:
    return list(STOP_WORDS) + (list(EXTRA_STOP_WORDS) if extra else [])


def _prefix_regex(words) -> str:
    """One regex alternation for a word list, grouped on shared prefixes, so that a
    token is rejected after a few character comparisons instead of a list scan."""
    import re

    def build(ws):
        end = "" in ws
        groups: dict[str, list[str]] = {}
        for w in ws:
            if w:
                groups.setdefault(w[0], []).append(w[1:])
        alts = [re.escape(c) + build(rest) for c, rest in sorted(groups.items())]
        if not alts:
            return ""
        body = "(?:" + "|".join(alts) + ")" if (len(alts) > 1 or end) else alts[0]
        return body + ("?" if end else "")

    return build(sorted(set(words)))


def keep_token_regex(extra: bool = False, stop: list[str] | None = None) -> str:
    """Regex accepting purely alphabetic tokens that are not stop words."""
    import re
    words = stop if stop is not None else stop_list(extra)
    alpha = [w for w in words if re.fullmatch(r"\w+", w) and not re.search(r"[\d_]", w)]
    if not alpha:
        return ALPHA_ONLY
    return "^(?!(?:" + _prefix_regex(alpha) + ")$)\\p{L}+$"


def filter_tokens(col, extra: bool = False, stop: list[str] | None = None) -> Column:
    """Keep purely alphabetic tokens not in the stop list (array → array).

    Stop words that are not purely alphabetic can never pass the alphabetic test, so
    only the alphabetic ones go into the single rejecting look-ahead.
    """
    pattern = keep_token_regex(extra, stop)
    return F.filter(_c(col), lambda t: t.rlike(pattern))


def truncate_words(col, k: int = 48) -> Column:
    """First ``k`` whitespace tokens joined by one space, ``...`` appended when longer."""
    s = F.regexp_replace(_c(col), "^" + WS + "+|" + WS + "+$", "")
    toks = F.split(s, WS + "+")
    n = F.when(F.length(s) == 0, F.lit(0)).otherwise(F.size(toks))
    head = F.array_join(F.slice(toks, 1, k), " ")
    return F.when(n > k, F.concat(head, F.lit("..."))).otherwise(head)


def sentence_pairs(col, size: int = 2, sep: str = "<br>") -> Column:
    """Split after ``.!?`` + spaces, group ``size`` sentences, join groups with ``sep``."""
    parts = F.split(_c(col), "(?<=[.!?]) +")
    n_groups = F.ceil(F.size(parts) / F.lit(size)).cast("int")
    groups = F.transform(F.sequence(F.lit(0), n_groups - 1),
                         lambda i: F.array_join(F.slice(parts, i * size + 1, size), " "))
    return F.array_join(groups, sep)


def encode_coords(col) -> Column:
    """Vector → comma-joined string."""
    return F.array_join(F.transform(_c(col), lambda x: x.cast("string")), ",")


def decode_coords(col) -> Column:
    """Comma-joined string → ``array<double>`` (unparsable items → null)."""
    return F.transform(F.split(_c(col), ","), lambda x: F.trim(x).try_cast("double"))
