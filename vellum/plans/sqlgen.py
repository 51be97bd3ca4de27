"""DuckDB SQL fragments for the oracle, built from the same fixed patterns as the
Spark column functions (RE2 accepts the same class strings; group references differ)."""

from __future__ import annotations

from vellum.functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def collapse_ws(expr: str) -> str:
    # Spark's trim removes spaces only; after the collapse only single spaces remain.
    return f"trim({rx(expr, T.WS + '+', ' ')}, ' ')"


def strip_html(expr: str) -> str:
    return rx(expr, "<[^>]+>", "")


def clean_markup(expr: str) -> str:
    return collapse_ws(strip_html(f"CAST({expr} AS VARCHAR)"))


def token_text(expr: str) -> str:
    e = f"lower({expr})"
    for pattern, _, repl in T.TOKEN_STEPS:
        e = rx(e, pattern, repl)
    return e


def stop_array(extra: bool = False) -> str:
    return "[" + ", ".join(q(w) for w in T.stop_list(extra)) + "]"


def word_tokens(expr: str) -> str:
    return f"list_filter(string_split({token_text(expr)}, ' '), lambda x: length(x) > 0)"


def filtered_tokens(expr: str, extra: bool = False) -> str:
    """clean mark-up → tokens → alphabetic non-stop tokens (a DuckDB list)."""
    return (f"list_filter({word_tokens(clean_markup(expr))}, lambda x: "
            f"regexp_full_match(x, '\\p{{L}}+') AND NOT list_contains({stop_array(extra)}, x))")


def bigrams(lst: str) -> str:
    return f"list_transform(range(1, len({lst})), lambda i: {lst}[i] || ' ' || {lst}[i + 1])"


def ngrams12(lst: str) -> str:
    return f"list_concat({lst}, {bigrams(lst)})"


def key_hash(expr: str) -> str:
    """First 32 bits of md5(key) as an integer (same value as the Spark helper)."""
    return f"CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8)) AS BIGINT)"
