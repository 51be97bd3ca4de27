"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and keeps the measurements and one
failure bit per rule. A policy is a versioned set of rule bits: ``apply_policy`` turns the
ledger into verdicts without touching the texts again, and ``ablation`` counts, from the
bits alone, what each rule removes and what it removes on its own.

Defined results: a null or empty text has no words, so it fails ``few_words``; repeated
rows are judged row by row; further columns of the input are kept out of the ledger unless
named in ``keep`` (a struct column keeps any, whatever their names); an empty table gives an
empty ledger. All measurements cover whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import textspans as ts

# Rule bits in ledger order: name -> failure condition over the measurements, in integers
# so that every engine computes the same verdict.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_lines",
    "capitals": "100 * n_capitals > 50 * n_letters",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

# Versioned policies: the rules that a document must pass.
POLICIES = {
    "v1": sum(BIT.values()),
    "base": BASE,
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A"):ord("Z") + 1] = True
_LETTER = _CAPITAL.copy()
_LETTER[ord("a"):ord("z") + 1] = True


def measure(chunk: ts.Chunk) -> dict[str, np.ndarray]:
    """All measurements of a chunk of documents, one int64 array each."""
    n, data = chunk.n, chunk.data
    start, end, doc = ts.word_spans(chunk)
    words = np.bincount(doc, minlength=n)

    heads = np.zeros(len(data) + 1, np.int64)  # code points: bytes that do not continue one
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    chars = np.bincount(doc, weights=heads[end] - heads[start], minlength=n).astype(np.int64)

    l_start, l_end, l_doc = ts.line_spans(chunk)
    has_word = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
    line, w_doc = ts.codes(data, l_start[has_word], l_end[has_word])[0], l_doc[has_word]
    distinct = _distinct_per_doc(line, w_doc, n)

    word = ts.codes(data, start, end)[0]
    repeat = np.zeros(len(start) + 2, bool)
    place = np.flatnonzero(doc[:len(doc) - 2] == doc[2:])  # windows of three words in one document
    if len(place):
        again = place[_occurs_again(word[place], word[place + 1], word[place + 2], doc[place])]
        for k in range(3):
            repeat[again + k] = True
    repeats = np.bincount(doc, weights=repeat[:len(start)], minlength=n).astype(np.int64)
    return {
        "n_words": words, "word_chars": chars, "n_symbols": chunk.per_doc(_SYMBOL[data]),
        "n_dup_lines": np.bincount(w_doc, minlength=n) - distinct, "n_repeat_words": repeats,
        "n_lines": np.bincount(w_doc, minlength=n), "n_letters": chunk.per_doc(_LETTER[data]),
        "n_capitals": chunk.per_doc(_CAPITAL[data]),
    }


def _distinct_per_doc(code: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=n)


def _occurs_again(*parts: np.ndarray) -> np.ndarray:
    """Mask of the rows whose parts, all together, occur at least twice."""
    key = parts[0]
    for part in parts[1:]:
        key = key * (int(part.max()) + 1) + part
        if len(key) and int(key.max()) >= 1 << 31:
            key = np.unique(key, return_inverse=True)[1]
    _, key, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[key] > 1


def ledger(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, the measurements and ``fail_bits`` (one bit per rule of ``RULES``).

    One pass over the texts in Arrow batches; no shuffle.
    """
    kept = [id_col, *[c for c in keep if c != id_col]]
    src = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType([*src.schema.fields[:len(kept)], *[T.StructField(m, T.LongType()) for m in MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(kept))
            for part in ts.chunks(column):
                rows = [batch.column(i).slice(part.lo, part.n) for i in range(len(kept))]
                found = measure(part)
                yield pa.RecordBatch.from_arrays([*rows, *[pa.array(found[m].astype(np.int64)) for m in MEASURES]], names=[*kept, *MEASURES])

    return src.mapInArrow(run, schema).withColumn("fail_bits", fail_bits())


def fail_bits() -> Column:
    """The failure bits from the measurement columns."""
    bits = F.lit(0)
    for name, condition in RULES.items():
        bits = bits + F.when(F.expr(condition), BIT[name]).otherwise(0)
    return bits.cast("long")


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Add ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """Per policy and rule: documents that fail it, and documents that fail nothing else.

    Columns ``policy, rule, n_docs, n_kept, n_fail, n_only``: ``n_only`` is what dropping the
    rule from the policy would bring back. Computed from the distribution of ``fail_bits``
    alone (at most ``2**len(RULES)`` rows), so no verdict is evaluated twice.
    """
    policies = policies or POLICIES
    counts = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"))
                      for p, m in policies.items() for r in RULES if m & BIT[r]])
    e = counts.withColumn("e", F.explode(pairs)).select("fail_bits", "n", "e.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return e.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"), F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))
