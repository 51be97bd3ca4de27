"""Importance resampling of documents towards a target distribution of hashed n-grams.

Words and pairs of neighbouring words hash into a fixed number of buckets. Bucket counts of all
documents and of all target texts give each bucket a gain (log ratio of its smoothed shares); a
document's weight is the mean gain of its features, read from one array of gains. With seeded
Gumbel noise added, the highest scores are a draw without replacement in proportion to the
exponential of the weights.

Ranks come from parallel sorting by regular sampling. Rows are dealt into runs; each run is
sorted locally and gives regularly spaced samples; the sorted samples give splitters, again at
regular places; runs exchange their segments between splitters, each receiver merges its sorted
pieces, and prefix sums of the segments' sizes turn local places into exact ranks. No segment
can hold more than about twice its share, however the scores are distributed:
keys are unique, so equal scores spread like others.

Defined results: a null or empty text has no features and weight 0; rows that repeat an id are
rows of their own, with the same noise; a null id hashes as an empty one; of rows with equal
score and id the one with the smaller digest of its text comes first, and rows alike in that too
are interchangeable; further columns are ignored; an empty table gives an empty one, an empty
target gives no text a preference beyond the documents' own counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vellum.llm import textspans as ts
from vellum.llm.lineage import materialise

BUCKETS = 10_000
MIN_WORDS = 20
SHARE = 25  # percent of the documents with MIN_WORDS words that are drawn
SCALE = 1000  # gains and noise are whole thousandths
RUN_ROWS = 4096
MAX_RUNS = 512  # one task sorts the samples, at most about MAX_RUNS ** 2 rows

# Bytes of a word: the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20




def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of checksums, given by its values for each byte: ``table[k, byte]``."""
    return table[0][crc & 0xFF] ^ table[1][(crc >> 8) & 0xFF] ^ table[2][(crc >> 16) & 0xFF] ^ table[3][crc >> 24]


@lru_cache(maxsize=1 << 12)
def _zeros(n: int) -> np.ndarray:
    """The map that ``n`` zero bytes after a text apply to its checksum (by halving ``n``)."""
    if n <= 1:
        byte = np.arange(256, dtype=np.uint32)
        crc = byte[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        if n == 0:
            return crc
        one = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32) ^ np.uint32(zlib.crc32(b"\0"))
        return one[crc & 0xFF] ^ (crc >> np.uint32(8))
    half = _zeros(n // 2)
    twice = _apply(half, half)
    return _apply(_zeros(1), twice) if n % 2 else twice


def feature_buckets(part: ts.Chunk, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and documents of all words, then of all pairs of neighbouring words, of a chunk.

    A bucket is the feature's crc32 modulo ``buckets``. Each distinct word is hashed once; a
    pair's checksum follows from its words' checksums and the second one's length.
    """
    data = _LOWER[part.data]
    start, end, doc = ts.runs(part, _WORD[data])
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    raw = data[ts.ragged(start, end - start)]
    off = np.append(0, np.cumsum(end - start)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(raw)]).dictionary_encode()
    spelled = coded.dictionary.to_pylist()
    crc = np.fromiter(map(zlib.crc32, spelled), np.uint32, len(spelled))[np.asarray(coded.indices)]
    size, which = np.unique(end - start, return_inverse=True)
    first, second = crc[:-1], crc[1:]
    pair = np.flatnonzero(doc[:-1] == doc[1:])
    first, second, which = first[pair], second[pair], which[1:][pair]
    blank = np.array([_apply(_zeros(n), np.uint32(zlib.crc32(b" "))) for n in size.tolist()], np.uint32)
    after = np.stack([_zeros(n + 1) for n in size.tolist()])
    both = blank[which] ^ second
    for k in range(4):
        both ^= after[which, k, (first >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return (crc % buckets).astype(np.int64), doc, (both % buckets).astype(np.int64), doc[pair]


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket (empty ones left out)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in ts.chunks(batch.column(0)):
                one, _, two, _ = feature_buckets(part, buckets)
                total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Whole gain of each bucket, from two tables of bucket counts (``buckets`` rows at most)."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, into in ((source, s), (target, t)):
        for r in counts.collect():
            into[r["bucket"]] = r["n"]
    all_s, all_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(SCALE * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id, n_words, n_features, weight, digest`` of every row."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("digest"))
    id_type = src.schema["id"].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ts.chunks(batch.column(1)):
                one, d1, two, d2 = feature_buckets(part, len(gain))
                n_words = np.bincount(d1, minlength=part.n)
                n = n_words + np.bincount(d2, minlength=part.n)
                total = np.zeros(part.n, np.int64)
                for bucket, doc in ((one, d1), (two, d2)):
                    run_sum = np.append(0, np.cumsum(gain[bucket]))
                    edge = np.searchsorted(doc, np.arange(part.n + 1))
                    total += run_sum[edge[1:]] - run_sum[edge[:-1]]
                rows = batch.slice(part.lo, part.n)
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(arrow_id), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1)), rows.column(2)],
                                                 names=["id", "n_words", "n_features", "weight", "digest"])

    return src.mapInArrow(run, T.StructType([T.StructField("id", id_type)] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "digest")]))


def noise(id_col: str, seed: int) -> Column:
    """Whole Gumbel noise of an id: the first 32 bits of sha256(``seed:id``) as a uniform number."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(1 << 32))))).cast("long")


def sample_sort(rows: DataFrame, key: list[str], run_rows: int | None = None) -> DataFrame:
    """``rows`` with ``rank``: the exact place (from 1) in ascending order of ``key``, by regular sampling.

    ``rows`` is read several times and must give the same rows each time (a written table);
    ``key`` must be unique. No window here spans more than one run or one segment.
    """
    n = rows.count()
    p = min(MAX_RUNS, max(1, -(-n // (run_rows or RUN_ROWS))))
    order = [F.col(k) for k in key]
    dealt = rows.withColumn("_run", F.pmod(F.xxhash64(*key), F.lit(p)).cast("int"))
    # Regular samples: every step-th row of each sorted run, about p of each.
    step = max(1, n // (p * p))
    placed = dealt.select("_run", *key).withColumn("_place", F.row_number().over(Window.partitionBy("_run").orderBy(*order)))
    samples = materialise(placed.filter(F.col("_place") % step == 0).select(*key), "samples")
    apart = max(1, -(-samples.count() // p))
    splitters = (samples.withColumn("_place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
                 .filter(F.col("_place") % apart == 0).select(*key))
    # Every sorted run is cut at the splitters: a row's segment is the number of splitters at or before it.
    in_runs = splitters.withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).withColumn("_cut", F.lit(1))
    both = dealt.withColumn("_cut", F.lit(0)).unionByName(in_runs, allowMissingColumns=True)
    up_to = Window.partitionBy("_run").orderBy(*order, F.col("_cut").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = materialise(both.withColumn("_segment", F.sum("_cut").over(up_to)).filter("_cut = 0").drop("_cut", "_run"), "segments")
    # One row per segment: the sizes of all segments before it.
    sizes = cut.groupBy("_segment").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_segment", F.coalesce(F.sum("_n").over(
        Window.partitionBy(F.lit(0)).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = cut.withColumn("_place", F.row_number().over(Window.partitionBy("_segment").orderBy(*order)))
    return (local.join(F.broadcast(before), "_segment")  # at most MAX_RUNS rows
            .withColumn("rank", (F.col("_before") + F.col("_place")).cast("long")).drop("_segment", "_place", "_before"))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", id_col: str = "doc_id", target_text: str = "text",
             share: int = SHARE, min_words: int = MIN_WORDS, seed: int = 7) -> DataFrame:
    """``id_col, n_features, weight, score, rank`` of every row; ``rank`` is null for rows not drawn.

    Drawn are the ``share`` percent (rounded down) highest scores of the rows with at least
    ``min_words`` words, ties to the smaller id.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    scored = weigh(docs, gain, text, id_col).withColumn("score", F.col("weight") + noise("id", seed)).withColumn("uid", F.monotonically_increasing_id())
    scored = materialise(scored.withColumn("down", -F.col("score")).withColumn("digest", F.coalesce("digest", F.lit(0))), "scored")
    able = scored.filter(F.col("n_words") >= min_words)
    quota = able.count() * share // 100
    ranked = sample_sort(able, ["down", "id", "digest", "uid"])
    out = ranked.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank"))).unionByName(scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
