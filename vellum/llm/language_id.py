"""Language identification by a linear-chain conditional random field over words.

Every word gets a label. Its evidence is a sum of learned weights of affixes (first and last
one to four bytes), byte n-grams of the marked word and a lexicon entry; learned transitions
tie neighbouring words, so a switch of language needs evidence. Marginals come from exact
forward-backward over the whole text. A text's language is the label with the largest mean
marginal, which is its score.

The chain of a chunk of documents is evaluated as products of small matrices: a document's
first word has a matrix that forgets what stands before it, so documents of any length,
from one word to a whole chunk, are dealt with in blocks of equal length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import textspans as ts
from vellum.llm.textspans import ragged

UNDETERMINED = "und"
BUCKETS = 1 << 17
#: Bounds of the training sample: documents of each language, about, and words of each document.
MAX_PER_LANGUAGE = 1200
SEGMENT_WORDS, SEGMENTS = 25, 3
EPOCHS, RATE, DECAY = 40, 0.25, 1e-6
LEXICON_MIN = 3  # a word is in the lexicon if it occurs so often in the sample
_CHUNK = 2 << 20
_BLOCK = 256

_WORD = np.zeros(256, bool)
_WORD[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_ASCII_LETTER = _WORD.copy()
_ASCII_LETTER[0x80:] = False


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the accented capitals of the Latin-1 block, byte by byte."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 0x20
    return out


def _words(part: ts.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the runs of ASCII letters and non-ASCII bytes."""
    letters = _WORD[part.data]
    return ts.word_spans(ts.Chunk(part.lo, np.where(letters, part.data, np.uint8(0x20)), part.off))


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the affix, n-gram and lexicon features of the given words, by word."""
    n = end - start
    marked = np.zeros(int((n + 2).sum()), np.uint8)
    first = np.cumsum(n + 2) - (n + 2)
    marked[first], marked[first + n + 1] = 2, 3
    marked[ragged(first + 1, n)] = data[ragged(start, n)]
    prefix = ts.prefix_hash(marked)
    word = np.arange(len(n))
    found: list[tuple[np.ndarray, np.ndarray]] = [(word, ts.span_hash(prefix, first, first + n + 2) ^ np.uint64(1))]
    for k in range(1, 5):
        long = np.flatnonzero(n >= k)
        a = first[long] + 1
        z = first[long] + 1 + n[long]
        found.append((long, ts.span_hash(prefix, a, a + k) ^ np.uint64(2)))
        found.append((long, ts.span_hash(prefix, z - k, z) ^ np.uint64(3)))
    for k in (2, 3, 4):
        count = np.maximum(n + 3 - k, 0)
        at = ragged(first, count)
        found.append((np.repeat(word, count), ts.span_hash(prefix, at, at + k) ^ np.uint64(4)))
    words = np.concatenate([w for w, _ in found])
    bucket = (ts.mix64(np.concatenate([h for _, h in found])) % np.uint64(BUCKETS)).astype(np.int64)
    order = np.argsort(words, kind="stable")
    return words[order], bucket[order]


def forward_backward(evidence: np.ndarray, begins: np.ndarray, transition: np.ndarray, initial: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward messages of a chain of words.

    ``evidence`` (words x labels) are positive factors; ``begins`` marks the words that open a
    text; ``transition`` and ``initial`` are positive. The marginals are the normalised product.
    """
    n, labels = evidence.shape
    blocks = -(-n // _BLOCK)
    e = np.ones((blocks * _BLOCK, labels))
    e[:n] = evidence
    fresh = np.zeros(blocks * _BLOCK, bool)
    fresh[:n] = begins
    fresh[n:] = True  # what fills the last block tells nothing about the words before it
    e, fresh = e.reshape(blocks, _BLOCK, labels), fresh.reshape(blocks, _BLOCK)
    restart = np.repeat(initial[None, :], labels, 0)
    step = np.where(fresh[:, :, None, None], restart, transition)  # matrix into each word

    product = np.repeat(np.eye(labels)[None], blocks, 0)
    for t in range(_BLOCK):
        product = np.matmul(product, step[:, t]) * e[:, t, None, :]
        product /= product.sum(axis=(1, 2), keepdims=True)
    head, tail = np.empty((blocks, labels)), np.empty((blocks, labels))
    state = np.full(labels, 1 / labels)
    for b in range(blocks):
        head[b] = state
        state = state @ product[b]
        state /= state.sum()
    state = np.full(labels, 1 / labels)
    for b in range(blocks - 1, -1, -1):
        tail[b] = state
        state = product[b] @ state
        state /= state.sum()

    alpha, beta = np.empty_like(e), np.empty_like(e)
    a, b = head, tail
    for t in range(_BLOCK):
        a = np.matmul(a[:, None, :], step[:, t])[:, 0] * e[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
    for t in range(_BLOCK - 1, -1, -1):
        beta[:, t] = b
        b = np.matmul(step[:, t], (b * e[:, t])[:, :, None])[:, :, 0]
        b /= b.sum(axis=1, keepdims=True)
    return alpha.reshape(-1, labels)[:n], beta.reshape(-1, labels)[:n]


def _marginals(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """Feature weights (bucket x label), transition and initial scores (logs), and the labels."""

    labels: list[str]
    weight: np.ndarray
    transition: np.ndarray
    initial: np.ndarray

    def evidence(self, n: int, word: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        first = np.searchsorted(word, np.arange(n))
        return np.add.reduceat(self.weight[bucket], first, axis=0) if n else np.zeros((0, len(self.labels)))

    def label_words(self, part: ts.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document, marginals) of every word of a chunk."""
        start, end, doc = _words(part)
        if not len(start):
            return start, end, doc, np.zeros((0, len(self.labels)))
        data = _lower(part.data)
        _, first, inverse = np.unique(ts.span_hash(ts.prefix_hash(data), start, end), return_index=True, return_inverse=True)
        score = self.evidence(len(first), *_features(data, start[first], end[first]))
        factor = np.exp(score - score.max(axis=1, keepdims=True))[inverse]
        begins = np.append(True, doc[1:] != doc[:-1])
        return start, end, doc, _marginals(*forward_backward(np.maximum(factor, 1e-30), begins, np.exp(self.transition), np.exp(self.initial)))


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Model:
    """Learn weights and transitions from texts with a language each.

    Segments of the texts are strung together in random order, several to a chain, so that
    the chains switch language at known places.
    """
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    column = pa.array([*texts], pa.string())
    spans = []
    data, off = ts.utf8_buffers(column)
    part = ts.Chunk(0, data, off)
    low = _lower(data)
    start, end, doc = _words(part)
    bounds = np.searchsorted(doc, np.arange(part.n + 1))
    for i in range(part.n):
        a, b = int(bounds[i]), int(bounds[i + 1])
        for _ in range(SEGMENTS if b - a > SEGMENT_WORDS else 1):
            s = a + int(rng.integers(0, max(1, b - a - SEGMENT_WORDS + 1)))
            if b > a:
                spans.append((s, min(b, s + SEGMENT_WORDS), labels.index(langs[i])))
    rng.shuffle(spans)
    model = Model(labels, np.zeros((BUCKETS, len(labels))), np.zeros((len(labels), len(labels))), np.zeros(len(labels)))
    if len(labels) < 2 or not spans:
        return model
    word = np.concatenate([np.arange(a, b) for a, b, _ in spans])
    gold = np.concatenate([np.full(b - a, y) for a, b, y in spans])
    chain = np.repeat(np.arange(len(spans)) // 3, [b - a for a, b, _ in spans])
    begins = np.append(True, chain[1:] != chain[:-1])
    _, first, inverse, count = np.unique(ts.span_hash(ts.prefix_hash(low), start[word], end[word]), return_index=True, return_inverse=True, return_counts=True)
    f_word, bucket = _features(low, start[word][first], end[word][first])
    # Feature 0 of a word is its lexicon entry; rare words have none.
    heads = np.searchsorted(f_word, np.arange(len(first)))
    keep = np.ones(len(bucket), bool)
    keep[heads[count < LEXICON_MIN]] = False
    f_word, bucket = f_word[keep], bucket[keep]

    hot = np.eye(len(labels))
    gold_pairs = hot[gold[:-1]].T @ (hot[gold[1:]] * ~begins[1:, None])
    squares = [np.full_like(x, 1e-6) for x in (model.weight, model.transition, model.initial)]
    for _ in range(EPOCHS):
        score = model.evidence(len(first), f_word, bucket)
        factor = np.maximum(np.exp(score - score.max(axis=1, keepdims=True)), 1e-30)[inverse]
        trans = np.exp(model.transition)
        alpha, beta = forward_backward(factor, begins, trans, np.exp(model.initial))
        error = hot[gold] - _marginals(alpha, beta)
        per_word = np.stack([np.bincount(inverse, weights=error[:, k], minlength=len(first)) for k in range(len(labels))], 1)
        grad = np.stack([np.bincount(bucket, weights=per_word[f_word, k], minlength=BUCKETS) for k in range(len(labels))], 1)
        joint = alpha[:-1, :, None] * trans * (factor[1:] * beta[1:])[:, None, :]
        joint = joint / joint.sum(axis=(1, 2), keepdims=True) * ~begins[1:, None, None]
        grads = (grad, gold_pairs - joint.sum(axis=0), error[begins].sum(axis=0))
        for x, g, q in zip((model.weight, model.transition, model.initial), grads, squares, strict=True):
            q += g * g
            x += RATE * g / np.sqrt(q) - DECAY * x
    return model


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", max_per_language: int = MAX_PER_LANGUAGE) -> Model:
    """Fit on texts with a language, about ``max_per_language`` of each language, chosen by hash.

    Null languages, null texts and texts without a letter are not learned from.
    """
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("y")).filter("y IS NOT NULL AND t IS NOT NULL")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not sizes:
        return fit([], [])
    share = F.create_map(*[F.lit(v) for y, n in sizes.items() for v in (y, int(min(1.0, max_per_language / n) * 1_000_000))])[F.col("y")]
    chosen = known.filter(F.pmod(F.xxhash64("id", "t"), F.lit(1_000_000)) < share)

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), ("t", "ascending")])
        m = fit(group["t"].to_pylist(), group["y"].to_pylist())
        used = np.flatnonzero(np.any(m.weight, axis=1))
        rows = [("weight", used[:, None].repeat(len(m.labels), 1), m.weight[used])]
        kind, row, label, value = [], [], [], []
        for name, r, x in [*rows, ("transition", np.arange(len(m.labels))[:, None].repeat(len(m.labels), 1), m.transition), ("initial", np.zeros((1, len(m.labels)), int), m.initial[None])]:
            kind += [name] * x.size
            row.append(r.ravel())
            label += m.labels * len(x)
            value.append(x.ravel())
        return pa.table({"kind": kind, "row": np.concatenate(row).astype(np.int64), "label": label, "value": np.concatenate(value)})

    # The sample is bounded, so one task holds it; equal texts of one id count once.
    sample = chosen.select(F.xxhash64("id", "t").alias("h"), "t", "y").dropDuplicates(["h", "y"]).withColumn("one", F.lit(0))
    found = sample.groupBy("one").applyInArrow(solve, "kind string, row long, label string, value double").toArrow()
    labels = sorted(set(found["label"].to_pylist()))
    at = np.array([labels.index(x) for x in found["label"].to_pylist()], np.int64)
    kind, row, value = np.array(found["kind"].to_pylist()), found["row"].to_numpy(), found["value"].to_numpy()
    model = Model(labels, np.zeros((BUCKETS, len(labels))), np.zeros((len(labels), len(labels))), np.zeros(len(labels)))
    model.weight[row[kind == "weight"], at[kind == "weight"]] = value[kind == "weight"]
    model.transition[row[kind == "transition"], at[kind == "transition"]] = value[kind == "transition"]
    model.initial[at[kind == "initial"]] = value[kind == "initial"]
    return model


def _has_letter(part: ts.Chunk) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    out = part.per_doc(_ASCII_LETTER[part.data]) > 0
    for i in np.flatnonzero(~out & (part.per_doc(part.data >= 0x80) > 0)):
        out[i] = regex.search(r"\p{L}", part.data[part.off[i]:part.off[i + 1]].tobytes().decode("utf-8", "replace")) is not None
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col, lang_pred, score`` for every row of ``docs``: one pass, no shuffle.

    Defined results: ``und`` with score 0 for a null text, one without a letter, and where no
    language was learned; repeated rows are judged row by row; ties go to the first language in
    alphabetical order; a null id is kept; further columns are ignored.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.labels, UNDETERMINED], object)
        for batch in batches:
            for part in ts.chunks(batch.column(1), _CHUNK):
                best, score = np.full(part.n, len(m.labels)), np.zeros(part.n)
                if m.labels:
                    _, _, doc, p = m.label_words(part)
                    words = np.maximum(np.bincount(doc, minlength=part.n), 1)
                    mean = np.stack([np.bincount(doc, weights=p[:, k], minlength=part.n) / words for k in range(len(m.labels))], 1)
                    known = _has_letter(part)
                    best = np.where(known, mean.argmax(axis=1), len(m.labels))
                    score = np.where(known, np.clip(mean.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.n), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    schema = T.StructType([src.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
