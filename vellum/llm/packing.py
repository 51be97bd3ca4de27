"""Lexical retrieval packing of tokenised documents into fixed windows.

Documents are tokenised once. Sketches route related documents (near copies, shared passages,
shared rare tokens) into the same shard of about ``SHARD_DOCS`` documents. A shard holds a BM25
inverted index of all its documents, with document frequencies and the average length taken
over the whole table. A seed document opens a window; the index returns its unused neighbours
by score; those that fit are placed whole, best first, and the best of the rest is cut to fill
the window and seeds the next one. A shard's last window is written as sequences of
power-of-two lengths, so nothing is padded.

The algorithm is the same at every size; a shard bounds a task's work and memory. What routing
misses against a search of all documents is measured with ``best_fits``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import pretokens as pt
from vellum.llm import textspans as ts
from vellum.llm.lineage import materialise
from vellum.llm.textspans import ragged

WINDOW = 1024
SHARD_DOCS = 1024
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
END_ID = 0           # closes every document
SHINGLE = 5          # tokens of a hashed window of the routing sketch
SHINGLE_VALUES, TOKEN_VALUES = 4, 12
TEXT_BYTES = 8 << 20  # tokenised at a time: a word that repeats in them is looked up once
_CACHE_WORDS = 1 << 19  # about; twice as many at most


@dataclass
class Spelled:
    """Words (bytes) with their ids, word after word in one array."""

    words: pa.Array
    ids: np.ndarray
    off: np.ndarray

    def at(self, words: pa.Array) -> np.ndarray:
        """Place of each word, or -1."""
        if not len(self.words):
            return np.full(len(words), -1)
        return np.asarray(pc.index_in(words, value_set=self.words).fill_null(-1)).astype(np.int64)

    def take(self, at: np.ndarray) -> Spelled:
        n = np.diff(self.off)[at]
        return Spelled(self.words.take(pa.array(at)), self.ids[ragged(self.off[at], n)], np.append(0, np.cumsum(n)))

    def __add__(self, other: Spelled) -> Spelled:
        return Spelled(pa.concat_arrays([self.words, other.words]), np.concatenate([self.ids, other.ids]), np.append(self.off, self.off[-1] + other.off[1:]))


class WordIds:
    """Ids of words, remembered across the chunks and tasks of a worker (a bounded number of words)."""

    def __init__(self, vocab: pt.Vocabulary):
        self.vocab = vocab
        top = max(max(vocab.vocab.values()), *vocab.special.values())
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.known = self.older = self._spell(pa.array([], pa.large_binary()))

    def _spell(self, words: pa.Array) -> Spelled:
        ids = pt.encode_words(self.vocab, words.to_pylist())
        return Spelled(words, np.fromiter(chain.from_iterable(ids), self.dtype), np.append(0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))

    def encode(self, part: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a chunk's documents."""
        w = pt.words(part, self.vocab)
        inverse, contents = ts.codes(part.data, w.start, w.end)
        place = self.known.at(contents)
        missing = np.flatnonzero(place < 0)
        before = self.older.at(contents.take(pa.array(missing)))
        back, new = missing[before >= 0], missing[before < 0]
        place[back] = len(self.known.words) + np.arange(len(back))
        place[new] = len(self.known.words) + len(back) + np.arange(len(new))
        known = self.known + (self.older.take(before[before >= 0]) + self._spell(contents.take(pa.array(new)))) if len(missing) else self.known
        # The words met since the last change stay.
        self.older, self.known = (known, self._spell(contents[:0])) if len(known.words) > _CACHE_WORDS else (self.older, known)
        n = np.diff(known.off)[place][inverse]
        ids = known.ids[ragged(known.off[place][inverse], n)]
        ends = np.append(0, np.cumsum(n))
        return ids, ends[np.append(0, np.cumsum(np.bincount(w.doc, minlength=part.n)))]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(pt.vocabulary(path))


def unpacked(column: pa.Array | pa.ChunkedArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the compressed id lists of a column."""
    expand = zstandard.ZstdDecompressor().decompress
    raw = [expand(b) for b in column.to_pylist()]
    return np.frombuffer(b"".join(raw), dtype), np.append(0, np.cumsum([len(r) for r in raw], dtype=np.int64)) // dtype.itemsize


def tokenise(docs: DataFrame, tokenizer: str, text: str, id_col: str) -> DataFrame:
    """``id, n, tokens``: each document's ids and the closing id, as little-endian unsigned integers
    of two bytes (four, for a vocabulary of 65,536 ids or more), compressed."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, squeeze = word_ids(tokenizer), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in ts.chunks(batch.column(1), TEXT_BYTES):
                ids, off = words.encode(part)
                n = np.diff(off) + 1
                ends = np.cumsum(n)
                out = np.full(int(ends[-1]), END_ID, words.dtype)
                body = np.ones(len(out), bool)
                body[ends - 1] = False
                out[body] = ids
                raw, bounds = out.tobytes(), (np.append(0, ends) * words.dtype.itemsize).tolist()
                blobs = [squeeze(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.n), pa.array(n), pa.array(blobs, pa.binary())], names=["id", "n", "tokens"])

    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("n", T.LongType()), T.StructField("tokens", T.BinaryType())]))


def _term_counts(flat: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token, count) of every distinct token of each document, in that order."""
    n = len(off) - 1
    kind = np.uint32 if n * size < 1 << 32 else np.uint64
    key = np.sort(np.repeat(np.arange(n, dtype=kind) * kind(size), np.diff(off)) + flat.astype(kind))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(key)))
    key = key[first].astype(np.int64)
    return key // size, key % size, tf


def _weighted(flat: np.ndarray, off: np.ndarray, idf: np.ndarray, average: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token, BM25 weight) of every distinct token of each document that has a weight."""
    doc, token, tf = _term_counts(flat, off, len(idf))
    use = idf[token] > 0
    doc, token, tf = doc[use], token[use], tf[use]
    return doc, token, idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.diff(off)[doc] / average))


def document_frequency(tokens: DataFrame, dtype: np.dtype, size: int) -> DataFrame:
    """``token, df`` over all documents: counted within each task, then summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in ts.chunks(batch.column(0)):
                total += np.bincount(_term_counts(*unpacked(batch.column(0).slice(part.lo, part.n), dtype), size)[1], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "df"])

    return tokens.select("tokens").mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


class Index:
    """BM25 inverted index of one shard's documents."""

    def __init__(self, flat: np.ndarray, off: np.ndarray, idf: np.ndarray, average: float):
        self.n = len(off) - 1
        doc, token, weight = _weighted(flat, off, idf, average)
        self.bounds = np.searchsorted(doc, np.arange(self.n + 1))  # terms of each document
        terms = np.zeros(len(idf), np.int64)
        terms[token] = 1
        self.term_of = (np.cumsum(terms) - 1)[token]
        order = np.argsort(self.term_of, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.size = np.bincount(self.term_of)
        self.start = np.cumsum(self.size) - self.size

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard against a seed's distinct tokens."""
        t = self.term_of[self.bounds[seed]:self.bounds[seed + 1]]
        at = ragged(self.start[t], self.size[t])
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def pack_documents(flat: np.ndarray, off: np.ndarray, idf: np.ndarray, average: float, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` that hold every token of the documents
    ``flat[off[i]:off[i + 1]]`` once."""
    index = Index(flat, off, idf, average)
    length = np.diff(off)
    unused = np.ones(len(length), bool)
    carry: tuple[int, int] | None = None
    nxt = 0
    while True:
        if carry is None:
            while nxt < len(length) and not unused[nxt]:
                nxt += 1
            if nxt == len(length):
                return
            carry = (nxt, 0)
            unused[nxt] = False
        seed, at = carry
        carry = None
        while length[seed] - at >= window:
            yield [(seed, at, window)]
            at += window
        if at == length[seed]:
            continue
        pieces, room = [(seed, int(at), int(length[seed] - at))], int(window - (length[seed] - at))
        score = np.where(unused, index.scores(seed), -1.0)
        while room and unused.any():
            whole = np.where(length <= room, score, -1.0)
            j = int(whole.argmax())
            if whole[j] <= 0:  # nothing related fits whole
                j = int(score.argmax())
            take = int(min(length[j], room))
            pieces.append((j, 0, take))
            room -= take
            unused[j], score[j] = False, -1.0
            if take < length[j]:
                carry = (j, take)
        if room == 0:
            yield pieces
        else:
            yield from _powers_of_two(pieces)


def _powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Cut a short window into sequences of power-of-two lengths, longest first."""
    total = sum(p[2] for p in pieces)
    while total:
        left = 1 << (total.bit_length() - 1)
        total -= left
        seq = []
        while left:
            doc, start, n = pieces[0]
            take = min(n, left)
            seq.append((doc, start, take))
            left -= take
            pieces = ([(doc, start + take, n - take)] if take < n else []) + pieces[1:]
        yield seq


def _weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """BM25's inverse document frequency of every token (0 for those of most documents)."""
    return np.maximum(np.log((n_docs - df + 0.5) / (df + 0.5)), 0.0)


class Sketcher:
    """Routing values of a document: what it shares, with high probability, with related ones.

    ``SHINGLE_VALUES`` are minima of hashed token 5-grams: near copies and documents that share
    a passage agree on them. ``TOKEN_VALUES`` are pairs of samples of its tokens, each token with
    a chance in proportion to its weight: documents of one subject agree on them. ``lead`` is
    the first sample alone.
    """

    def __init__(self, idf: np.ndarray):
        rng = np.random.default_rng(11)
        with np.errstate(divide="ignore"):
            race = -np.log(rng.random((2 * TOKEN_VALUES, len(idf)))) / idf  # the least wins: a draw by weight
        self.rank = np.empty(race.shape, np.uint16 if len(idf) <= 1 << 16 else np.uint32)
        np.put_along_axis(self.rank, np.argsort(race, axis=1, kind="stable"), np.arange(len(idf)).astype(self.rank.dtype)[None], axis=1)
        self.useful = int((idf > 0).sum())
        numbers = np.arange(1, SHINGLE_VALUES + TOKEN_VALUES + 1, dtype=np.uint64)
        self.seeds, self.marks = ts.mix64(numbers * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), ts.mix64(numbers * np.uint64(0xA0761D6478BD642F))

    def __call__(self, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value or 0 by document and kind, lead) of documents of one token at least."""
        first, length = off[:-1], np.diff(off)
        values = np.zeros((len(first), SHINGLE_VALUES + TOKEN_VALUES), np.uint64)
        doc, token, _ = _term_counts(flat, off, self.rank.shape[1])  # a token counts once in a minimum
        begin = np.searchsorted(doc, np.arange(len(first)))
        best = [np.minimum.reduceat(np.take(r, token), begin) for r in self.rank]
        for j in range(TOKEN_VALUES):
            a, b = best[2 * j].astype(np.uint64), best[2 * j + 1].astype(np.uint64)
            v = ts.mix64((a << np.uint64(32) | b) + self.marks[j])
            values[:, SHINGLE_VALUES + j] = np.where(best[2 * j] < self.useful, v & ~np.uint64(1), 0)
        if len(flat) >= SHINGLE:
            h = np.zeros(len(flat) - SHINGLE + 1, np.uint64)
            for k in range(SHINGLE):
                h = h * np.uint64(0x9E3779B97F4A7C15) + flat[k:k + len(h)] + np.uint64(1)
            h = ts.mix64(h)
            long = np.flatnonzero(length >= SHINGLE)
            # A document's shingles, then those that run into the next one (left out).
            cuts = np.stack([first[long], first[long] + length[long] - SHINGLE + 1], axis=1).ravel()
            cuts = cuts[:-1] if len(cuts) and cuts[-1] >= len(h) else cuts
            for j in range(SHINGLE_VALUES if len(long) else 0):
                values[long, j] = ts.mix64(np.minimum.reduceat((h * self.seeds[j]) >> np.uint64(8), cuts)[::2] + self.marks[j]) | np.uint64(1)  # odd: a shingle's
        return values.view(np.int64), best[0].astype(np.int64)


def routes(tokens: DataFrame, idf, dtype: np.dtype, n_docs: int) -> DataFrame:
    """``uid, shard``: shards of about ``SHARD_DOCS`` documents (or ``SHARD_TOKENS`` ids) that share routing values.

    Documents that share a shingle value follow the one of smallest uid among them (in two
    steps: it may follow another), so near copies stay together; a leading document goes by the
    token value that most documents share, as long as a shard can hold them all. A value of more
    documents than a shard holds comes last: its documents fill several shards, however many
    they are; so a shard is less than twice its size. Only keys are moved here.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(idf.value)
        for batch in batches:
            for part in ts.chunks(batch.column(2)):
                found, lead = sketch(*unpacked(batch.column(2).slice(part.lo, part.n), dtype))
                row, kind = np.nonzero(found)
                bounds = np.searchsorted(row, np.arange(part.n + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.n), batch.column(1).slice(part.lo, part.n), pa.array(lead),
                                                  pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found[row, kind]))], names=["uid", "n", "lead", "values"])

    keys = materialise(tokens.select("uid", "n", "tokens").mapInArrow(run, "uid long, n long, lead long, values array<long>"), "sketches")
    each = keys.select("uid", F.explode("values").alias("value"))
    counts = materialise(each.groupBy("value").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("low")).filter("c > 1"), "values")
    often = max(SHARD_DOCS, n_docs // 1000)
    hot = F.broadcast(counts.filter(F.col("c") > often))  # at most 1,000 values of each kind
    shared = (each.join(hot.select("value"), "value", "left_anti").join(counts.filter(F.col("c") <= often), "value")
              .unionByName(each.join(hot, "value")))
    few, shingle = F.col("c") <= SHARD_DOCS, F.col("value").bitwiseAND(F.lit(1)) == 1
    subject = F.max(F.when(~(few & shingle), F.struct(F.when(few, F.col("c")).otherwise(-F.col("c")).alias("c"), "value")))
    found = shared.groupBy("uid").agg(F.min(F.when(few & shingle, F.col("low"))).alias("first"), subject.alias("subject"))
    led = materialise(keys.select("uid", "n", "lead").join(found, "uid", "left").select(
        "uid", "n", F.coalesce("first", "uid").alias("first"), F.col("subject").isNull().alias("alone"), F.coalesce("subject.value", "lead").alias("key")), "leaders")
    second = led.select(F.col("uid").alias("first"), F.col("first").alias("leader"))
    subjects = led.select(F.col("uid").alias("leader"), "alone", "key")
    order = ["alone", "key", "leader", "uid"]
    placed = (led.select("uid", "n", "first").join(second, "first").join(subjects, "leader")
              .select("uid", "alone", "key", "leader", F.greatest(F.lit(SHARD_TOKENS // SHARD_DOCS), F.least("n", F.lit(SHARD_TOKENS))).alias("cost"))
              .repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = materialise(placed, "order").withColumn("part", F.shiftrightunsigned("at", 33))
    # Prefix sums of the costs: of the partitions before, and of the rows before in the partition.
    sums = placed.groupBy("part").agg(F.sum("cost").alias("sum"))
    before = sums.select("part", F.coalesce(F.sum("sum").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    here = F.coalesce(F.sum("cost").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = placed.withColumn("here", here).join(F.broadcast(before), "part").withColumn("here", F.col("before") + F.col("here"))  # one row a partition
    # A group of copies that a shard can hold is not cut by a border.
    group = Window.partitionBy("leader")
    place = F.when(F.sum("cost").over(group) <= SHARD_TOKENS, F.min("here").over(group)).otherwise(F.col("here"))
    return at.select("uid", F.floor(place / SHARD_TOKENS).cast("long").alias("shard"))


def best_fits(tokens: DataFrame, asked: DataFrame, idf, average: float, dtype: np.dtype, window: int = WINDOW) -> DataFrame:
    """``seed, uid, score, self``: the best-scoring document that fits each seed's window whole, by exhaustive search.

    ``asked`` (``uid, n, tokens``) is a bounded set of seeds that is sent to every task; all
    documents are scored against it, and nothing is pruned. With it the shards' recall is measured.
    """
    seeds = asked.select("uid", "n", "tokens").orderBy("uid").collect()
    query = np.zeros((len(idf.value), len(seeds)))
    for k, r in enumerate(seeds):
        query[np.unique(unpacked(pa.array([r["tokens"]]), dtype)[0]), k] = 1.0
    names, room = np.array([r["uid"] for r in seeds], np.int64), np.array([window - r["n"] % window for r in seeds])
    sent = tokens.sparkSession.sparkContext.broadcast(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            doc, token, weight = _weighted(*unpacked(batch.column(2), dtype), idf.value, average)
            first = np.searchsorted(doc, np.arange(len(uid) + 1))
            for i in range(len(uid)):
                at = slice(first[i], first[i + 1])
                score = weight[at] @ sent.value[token[at]]
                fit = np.flatnonzero((score > 0) & ((n[i] <= room) | (names == uid[i])))
                yield pa.RecordBatch.from_arrays([pa.array(names[fit]), pa.array(np.full(len(fit), uid[i])), pa.array(score[fit])], names=["seed", "uid", "score"])

    scored = tokens.select("uid", "n", "tokens").mapInArrow(run, "seed long, uid long, score double")
    own = scored.filter("seed = uid").select("seed", F.col("score").alias("self"))
    best = scored.filter("seed <> uid").groupBy("seed").agg(F.max(F.struct("score", F.negative("uid").alias("u"))).alias("b"))
    return best.select("seed", (-F.col("b.u")).alias("uid"), "b.score").join(own, "seed")


def pack(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row per piece: ``id_col, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers; ``offset`` is the
    piece's place in its sequence, ``start`` its place in its document. A sequence has
    ``window`` ids, or a power of two (at the end of a shard).

    Defined results: a null or empty text is the closing id alone; repeated rows are packed
    row by row; texts longer than a window fill windows of their own first; further columns
    are ignored; an empty table gives an empty one.
    """
    tokens, idf, average, dtype, n_docs = prepare(docs, tokenizer, text, id_col)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending")])
        flat, off = unpacked(group["tokens"], dtype)
        base = group["shard"][0].as_py() << 32
        out = [(base + k, place, *p) for k, seq in enumerate(pack_documents(flat, off, idf.value, average, window))
               for place, p in zip(np.cumsum([0, *[p[2] for p in seq[:-1]]]).tolist(), seq, strict=True)]
        seq_id, place, doc, start, n = np.array(out, np.int64).reshape(-1, 5).T
        ids = flat[ragged(off[doc] + start, n)].astype("<u4")
        bounds = np.append(0, np.cumsum(n)) * 4
        blob = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
        return pa.table({"id": group["id"].take(pa.array(doc)), "start": pa.array(start), "length": pa.array(n), "doc_tokens": pa.array(np.diff(off)[doc]),
                         "sequence_id": pa.array(seq_id), "offset": pa.array(place), "ids": blob})

    long = T.LongType()
    schema = T.StructType([tokens.schema["id"], *[T.StructField(c, long) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")], T.StructField("ids", T.BinaryType())])
    dealt = tokens.select("uid", "id", "tokens").join(routes(tokens, idf, dtype, n_docs).hint("merge"), "uid").withColumn("h", F.xxhash64("id", "tokens"))
    return dealt.groupBy("shard").applyInArrow(run, schema).withColumnRenamed("id", id_col)


def prepare(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id"):
    """(tokens, idf, average length, dtype, documents): the written token table ``uid, id, n, tokens`` and its BM25 statistics."""
    vocab = pt.Vocabulary(tokenizer)
    dtype = WordIds(vocab).dtype
    size = max(max(vocab.vocab.values()), *vocab.special.values()) + 1
    tokens = materialise(tokenise(docs, tokenizer, text, id_col).withColumn("uid", F.monotonically_increasing_id()), "tokens")
    n_docs, n_tokens = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    for row in document_frequency(tokens, dtype, size).collect():  # bounded by the vocabulary, whatever the table holds
        df[row["token"]] = row["df"]
    return tokens, docs.sparkSession.sparkContext.broadcast(_weights(df, n_docs)), max(1.0, n_tokens / max(1, n_docs)), dtype, n_docs
