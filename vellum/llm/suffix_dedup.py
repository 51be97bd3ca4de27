"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``threshold`` bytes that covers it also starts earlier (in a
document of smaller id, or earlier in the same one). Prefix doubling sorts (rank, position)
pairs at growing offsets and reranks until a position is unique or the compared prefix is
past the threshold. Ranking every byte position would shuffle dozens of times the input, so
the rounds run on synchronising positions first and come back to single positions only
where a round left a question open:

* Round 1 ranks the first ``SEED`` bytes of the *anchor* of each window of ``threshold``
  bytes: the leftmost position with the smallest seed hash in it. Equal windows have equal
  anchors at equal places, and neighbouring windows share theirs, so about one position in
  ``threshold / 3`` is sorted. Anchors whose seed is unique leave.
* Round 2 doubles: the pair (seed rank, name of everything the anchor's windows cover).
  Pairs that are equal agree on all their windows; all but the earliest go. A seed with one
  such pair is settled.
* Round 3 compares, for the seeds that still have several pairs, the earliest position of
  each pair window by window over the full ``threshold``.

Names are 64-bit fingerprints used in pairs (seed and extent, seed and window), so strings
are only taken for equal when both agree. A chunk of documents sends each pair once, so a
passage that stands in a third of all documents costs one row per chunk, and the sort that
follows streams over runs of equal rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import textspans as ts
from vellum.llm.lineage import materialise
from vellum.operators.ranking import global_index

THRESHOLD = 100
SEED = 32
_CHUNK = 2 << 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == width else np.minimum(x[:len(x) - (width - span)], x[width - span:])


def _anchors(part: ts.Chunk, prefix: np.ndarray, threshold: int, seed: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, seed name, extent name) of every anchor of a chunk, by position.

    The extent name holds the number of further windows in its lowest byte.
    """
    n = len(part.data)
    long = np.flatnonzero(np.diff(part.off) >= threshold)
    if not len(long):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    at = np.arange(n - seed + 1)
    seeds = ts.span_hash(prefix, at, at + seed)
    order = (seeds >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    anchor = (_sliding_min(order, threshold - seed + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(n + 1, np.int8)
    edge[part.off[long]] += 1
    np.subtract.at(edge, part.off[long + 1] - threshold + 1, 1)
    window = np.flatnonzero(np.cumsum(edge, dtype=np.int8))
    p = anchor[window]
    start = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (window[1:] != window[:-1] + 1)))
    lo, hi, p = window[start], window[np.append(start[1:], len(window)) - 1], p[start]
    extent = ts.mix64(ts.span_hash(prefix, lo, hi + threshold) ^ ((p - lo).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    extent = (extent >> np.uint64(8) << np.uint64(8)) | (hi - lo).astype(np.uint64)
    return lo, hi, seeds[p].view(np.int64), extent.view(np.int64)


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by the keys (the first two name a class, the rest order it) and class-start flags."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    return order, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)


def _merge(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite intervals ``[lo, hi)`` of a document that overlap or touch."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    group = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
    shift = group * (int(hi.max()) + 1)  # one number line for all documents
    reach = np.maximum.accumulate(hi + shift)
    new = np.append(True, (lo + shift)[1:] > reach[:-1])
    new[at] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], reach[last] - shift[last]


def _table(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Regroup sorted batches so that no run of equal ``key`` is cut."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in now}
        cut = int(np.searchsorted(now[key], now[key][-1], "left"))
        if cut:
            yield {c: v[:cut] for c, v in now.items()}
        held = {c: v[cut:] for c, v in now.items()}
    if held is not None:
        yield held


def _mark_anchors(threshold: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for part in ts.chunks(batch.column(1), _CHUNK):
                lo, hi, name, extent = _anchors(part, ts.prefix_hash(part.data), threshold, seed)
                if not len(lo):
                    continue
                d = part.doc_of(lo)
                uid, base = uids[part.lo + d], part.off[d]
                order, first = _firsts(name, extent, uid, lo)
                keep, gone = order[first], order[~first]
                yield _table("name extent uid start stop", name[keep], extent[keep], uid[keep], lo[keep] - base[keep], np.zeros(len(keep), np.int64))
                g_uid, g_lo, g_hi = _merge(uid[gone], lo[gone] - base[gone], hi[gone] - base[gone] + threshold)
                yield _table("name extent uid start stop", ts.mix64(g_uid.astype(np.uint64)).view(np.int64), np.zeros(len(g_uid), np.int64), g_uid, g_lo, g_hi)
    return run


def _rank_anchors(threshold: int) -> Callable:
    """Rounds 1 and 2 over anchors sorted by (seed, extent, document, place): settled intervals
    (``name`` null) and open anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "name"):
            settled = t["stop"] > 0
            uid, start, stop = t["uid"][settled], t["start"][settled], t["stop"][settled]
            name, extent, u, s = (t[c][~settled] for c in ("name", "extent", "uid", "start"))
            if len(name):
                new_name = np.append(True, name[1:] != name[:-1])
                new_pair = new_name | np.append(True, extent[1:] != extent[:-1])
                further = extent & 0xFF
                pairs = np.add.reduceat(new_pair.astype(np.int64), np.flatnonzero(new_name))
                several = (pairs > 1)[np.cumsum(new_name) - 1]
                gone, ask = ~new_pair, new_pair & several
                uid = np.concatenate([uid, u[gone]])
                start = np.concatenate([start, s[gone]])
                stop = np.concatenate([stop, s[gone] + further[gone] + threshold])
                yield _table("uid start stop name", u[ask], s[ask], s[ask] + further[ask] + 1, name[ask])
            uid, start, stop = _merge(uid, start, stop)
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(start), pa.array(stop), pa.nulls(len(uid), pa.int64())], names=["uid", "start", "stop", "name"])
    return run


def _windows(threshold: int) -> Callable:
    """Names of all windows of the open anchors of each document, each name once a chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, asks = batch.column(0).to_numpy(), batch.column(2)
            for part in ts.chunks(batch.column(1), _CHUNK):
                rows = asks.slice(part.lo, part.n)
                flat = rows.flatten()
                d = np.repeat(np.arange(part.n), np.asarray(rows.value_lengths().fill_null(0)))
                if not len(d):
                    continue
                start, stop, name = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "stop", "name"))
                for a in range(0, len(d), 1 << 14):
                    s0, n = start[a:a + (1 << 14)], (stop - start)[a:a + (1 << 14)]
                    which = np.repeat(np.arange(len(s0)), n)
                    s = s0[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]
                    doc = d[a:a + (1 << 14)][which]
                    if a == 0:
                        prefix = ts.prefix_hash(part.data)
                    w = ts.span_hash(prefix, part.off[doc] + s, part.off[doc] + s + threshold).view(np.int64)
                    key, uid = name[a:a + (1 << 14)][which], uids[part.lo + doc]
                    order, first = _firsts(key, w, uid, s)
                    keep, gone = order[first], order[~first]
                    yield _table("name window uid start stop", key[keep], w[keep], uid[keep], s[keep], np.zeros(len(keep), np.int64))
                    g_uid, g_lo, g_hi = _merge(uid[gone], s[gone], s[gone] + threshold)
                    yield _table("name window uid start stop", ts.mix64(g_uid.astype(np.uint64)).view(np.int64), np.zeros(len(g_uid), np.int64), g_uid, g_lo, g_hi)
    return run


def _rank_windows(threshold: int) -> Callable:
    """Round 3 over windows sorted by (seed, window, document, place)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "name"):
            settled = t["stop"] > 0
            name, w, u, s = (t[c][~settled] for c in ("name", "window", "uid", "start"))
            again = np.zeros(len(name), bool)
            again[1:] = (name[1:] == name[:-1]) & (w[1:] == w[:-1])
            uid, start, stop = _merge(np.concatenate([t["uid"][settled], u[again]]), np.concatenate([t["start"][settled], s[again]]),
                                      np.concatenate([t["stop"][settled], s[again] + threshold]))
            yield _table("uid start stop", uid, start, stop)
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite each document's spans and take them out of its bytes."""
    for batch in batches:
        for part in ts.chunks(batch.column(1), _CHUNK):
            raw = batch.column(2).slice(part.lo, part.n)
            flat, counts = raw.flatten(), np.asarray(raw.value_lengths().fill_null(0))
            d, lo, hi = _merge(np.repeat(np.arange(part.n), counts), *[flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "stop")])
            edge = np.zeros(len(part.data) + 1, np.int8)
            np.add.at(edge, part.off[d] + lo, 1)
            np.subtract.at(edge, part.off[d] + hi, 1)
            keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
            size = part.per_doc(keep)
            bounds = np.append(0, np.cumsum(size))
            kept = pa.Array.from_buffers(pa.large_binary(), part.n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(part.data[keep])]).cast(pa.binary())
            n_spans = np.bincount(d, minlength=part.n)
            spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_spans)), pa.int32()), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["start", "stop"]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.lo, part.n), spans, kept], names=["r", "spans", "kept"])


def _within(names: list[str], path: str) -> Column:
    """A column of the row ``r``, or a field of one of its structs (``column.field``)."""
    if path in names or "." not in path:
        return F.col("r").getField(path)
    column, field = path.split(".", 1)
    return F.col("r").getField(column).getField(field)


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes``, ``n_removed``, ``spans`` and ``kept``.

    ``text`` and ``id_col`` are columns, or fields of a struct column (``row.text``).
    ``spans`` (``array<struct<start, stop>>``, UTF-8 byte offsets, ascending and disjoint) are
    the maximal repeated byte runs; ``kept`` (binary) is the text without them.

    Defined results: a null text is empty; texts shorter than ``threshold`` have no span. Rows
    that share an id, or have none, are documents of their own, ordered by id and text (equal
    rows in any order). All other columns of ``docs`` are kept, whatever their names (of a
    column named like a result, the result stands); an empty table gives an empty one.
    """
    if not 0 < seed < threshold or threshold - seed > 255:
        raise ValueError("seed must be shorter than the threshold, by 255 bytes at most")
    names = docs.columns
    ids, body = _within(names, id_col), F.coalesce(_within(names, text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"))
    odd = rows.select(ids.cast("long").alias("uid")).groupBy("uid").count().filter("uid IS NULL OR count > 1")
    if odd.isEmpty():
        rows = rows.select(ids.cast("long").alias("uid"), "r")
    else:
        rows = global_index(rows.select("r", ids.alias("i"), body.alias("b")), [F.col("i"), F.col("b")], "uid").select("uid", "r")

    anchors = rows.select("uid", body.alias("t")).mapInArrow(_mark_anchors(threshold, seed), "name long, extent long, uid long, start long, stop long")
    ranked = (anchors.repartition("name").sortWithinPartitions("name", "extent", "uid", "start")
              .mapInArrow(_rank_anchors(threshold), "uid long, start long, stop long, name long"))
    marks = materialise(ranked, "anchors")

    per_doc = marks.groupBy("uid").agg(
        F.collect_list(F.when(F.col("name").isNotNull(), F.struct("start", "stop", "name"))).alias("asks"),
        F.collect_list(F.when(F.col("name").isNull(), F.struct("start", "stop"))).alias("settled"))
    # One shuffle of the texts; what follows reads the rows with a mark only.
    joined = materialise(rows.join(per_doc, "uid", "left"), "marked")
    windows = (joined.filter(F.size("asks") > 0).select("uid", body.alias("t"), "asks")
               .mapInArrow(_windows(threshold), "name long, window long, uid long, start long, stop long"))
    found = (windows.repartition("name").sortWithinPartitions("name", "window", "uid", "start")
             .mapInArrow(_rank_windows(threshold), "uid long, start long, stop long"))
    late = found.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("late"))

    none_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    none = F.array().cast(none_type)
    raw = F.concat("settled", F.coalesce("late", none))
    hit = joined.filter(F.col("asks").isNotNull()).join(late, "uid", "left").select("r", body.alias("t"), raw.alias("raw"))
    schema = T.StructType([rows.schema["r"], T.StructField("spans", none_type), T.StructField("kept", T.BinaryType())])
    cut = hit.mapInArrow(_cut, schema)
    same = joined.filter(F.col("asks").isNull()).select("r", none.alias("spans"), F.encode(body, "UTF-8").alias("kept"))
    out = cut.unionByName(same)
    n_bytes = F.octet_length(body).cast("long")
    results = [n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"), F.col("spans"), F.col("kept")]
    return out.select(*[F.col("r").getField(c).alias(c) for c in names if c not in ("n_bytes", "n_removed", "spans", "kept")], *results)
