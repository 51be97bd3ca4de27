"""N-gram Jaccard self-join: MinHash banding, verified on full n-gram sets.

1. One pass over the texts gives each document its set of word n-grams as a 128-bit digest
   and its band hashes. Documents with equal sets form a copy class, represented by their
   smallest id; only representatives go on, so a class of any size costs one row.
2. Band hashes are shuffled; the members of a bucket are tied to its smallest member (one
   row each, no pairs), and connected components of these ties bound the search: every
   pair that shares a bucket lies in one component.
3. Components are verified on the full n-gram sets. Small ones are dealt together; a large
   one is cut into blocks and every pair of blocks is one unit of work, so no task holds
   more than two blocks. A unit emits one row per document (its number of links and its
   local root), never a row per pair.

The band count follows from the threshold, the rows per band and the target recall: a pair
at the threshold is missed with probability ``1 - recall`` at most, and less where other
documents tie the two together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import textspans as ts
from vellum.llm.lineage import components, materialise

N_WORDS = 5
THRESHOLD = Fraction(4, 5)
BAND_ROWS = 5
RECALL = 0.99995
BLOCK = 512          # documents in a block of a large component
UNIT_ROWS = 1024     # documents of small components that are dealt to one unit
_CHUNK = 2 << 20
_COLUMNS = 4096      # distinct n-grams of a strip of the incidence matrix


def band_count(threshold: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` hashes so that a pair at the threshold shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def grams_of(part: ts.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each document's distinct n-grams, sorted by document and hash.

    A text of 1 to n - 1 words has one n-gram, its whole word sequence.
    """
    start, end, doc = ts.word_spans(part)
    words = ts.digests(part.data, start, end)
    h, d = ts.ngram_hash(words, doc, n)
    for k in range(1, n):
        count = np.bincount(doc, minlength=part.n)
        short = count[doc] == k
        if short.any():
            sh, sd = ts.ngram_hash(words[short], doc[short], k)
            h, d = np.concatenate([h, sh]), np.concatenate([d, sd])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def _sketch(part: ts.Chunk, n: int, bands: int, rows: int) -> tuple[np.ndarray, ...]:
    """Per document with a word: (row, n-grams, two set digests, band hashes)."""
    h, d = grams_of(part, n)
    if not len(h):
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros((0, bands), np.int64)
    first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
    size = np.diff(np.append(first, len(h)))
    digests = [np.add.reduceat(ts.mix64(h ^ np.uint64(seed)), first).view(np.int64) for seed in (0x51ED270B, 0x2545F4914F6CDD1D)]
    seeds = ts.mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.empty((len(first), bands), np.int64)
    for b in range(bands):
        acc = np.zeros(len(first), np.uint64)
        for r in range(rows):
            low = np.minimum.reduceat((h * seeds[b * rows + r]) >> np.uint64(24), first)
            acc = ts.mix64(acc * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, b] = ts.mix64(acc + np.uint64(b)).view(np.int64)
    return d[first], size, digests[0], digests[1], out


def sketches(docs: DataFrame, text: str, id_col: str, n: int = N_WORDS, bands: int = 1, rows: int = BAND_ROWS) -> DataFrame:
    """``id, n_grams, g1, g2, bands`` for every document; null digests where it has no word."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ts.chunks(batch.column(1), _CHUNK):
                row, size, g1, g2, found = _sketch(part, n, bands, rows)
                ids = batch.column(0).slice(part.lo, part.n)
                empty = np.setdiff1d(np.arange(part.n), row)
                take = pa.array(np.concatenate([row, empty]))
                gone = pa.nulls(len(empty), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, bands), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), pa.concat_arrays([pa.array(size.astype(np.int64)), pa.array(np.zeros(len(empty), np.int64))]),
                     pa.concat_arrays([pa.array(g1), gone]), pa.concat_arrays([pa.array(g2), gone]),
                     pa.concat_arrays([lists, pa.nulls(len(empty), lists.type)])], names=["id", "n_grams", "g1", "g2", "bands"])

    return src.mapInArrow(run, "id long, n_grams long, g1 long, g2 long, bands array<long>")


def _gram_sets(rows: DataFrame, n: int) -> DataFrame:
    """Replace ``t`` by ``grams``, the document's sorted distinct n-gram hashes as bytes."""
    keep = [c for c in rows.columns if c != "t"]
    src = rows.select(*keep, "t")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keep).schema] + ["grams binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ts.chunks(batch.column(len(keep)), _CHUNK):
                h, d = grams_of(part, n)
                bounds = np.searchsorted(d, np.arange(part.n + 1)) * 8
                sets = pa.Array.from_buffers(pa.large_binary(), part.n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(part.lo, part.n) for i in range(len(keep))], sets.cast(pa.binary())], names=[*keep, "grams"])

    return src.mapInArrow(run, schema)


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column, columns) of the n-grams that at least two of the sets hold."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    used = shared[inverse]
    return row[used], column[inverse[used]], int(shared.sum())


def _intersections(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of ``sets[:split]`` with ``sets[split:]`` (all with all if split is 0)."""
    row, col, n_cols = _incidence(sets)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    a = split or len(sets)
    out = np.zeros((a, len(sets) - split), np.float32)
    for lo in range(0, n_cols, _COLUMNS):
        i, j = np.searchsorted(col, [lo, lo + _COLUMNS])
        strip = np.zeros((len(sets), min(_COLUMNS, n_cols - lo)), np.float32)
        strip[row[i:j], col[i:j] - lo] = 1
        out += strip[:a] @ strip[split:].T
    return out.astype(np.int64)


def _verify(ids: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray, limit: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, local root) of the documents with a link; side 1 only meets side 0, side 0 meets
    itself unless there is a side 1."""
    order = np.argsort(side, kind="stable")
    ids, copies, sets = ids[order], copies[order], [sets[i] for i in order]
    split = int((side == 0).sum()) if side.any() else 0
    size = np.array([len(s) for s in sets])
    common = _intersections(sets, split)
    rest = np.arange(split, len(sets))
    near = common * (limit.numerator + limit.denominator) >= limit.numerator * (size[:len(common), None] + size[None, rest])
    if not split:
        np.fill_diagonal(near, False)
        links = near @ copies
        a, b = np.nonzero(np.triu(near))
    else:
        links = np.concatenate([near @ copies[split:], near.T @ copies[:split]])
        a, b = np.nonzero(near)
        b = b + split
    root = _roots(len(ids), a, b, ids)
    some = links > 0
    return ids[some], links[some], root[some]


def _roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each node's component, by repeated minima over the links."""
    label = np.argsort(np.argsort(ids))
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            break
        label = new
    return np.sort(ids)[label]


def similarity_join(docs: DataFrame, text: str = "text", id_col: str = "doc_id", n: int = N_WORDS, threshold: Fraction = THRESHOLD,
                    band_rows: int = BAND_ROWS, recall: float = RECALL) -> DataFrame:
    """``id_col, copy_id, class_id, n_links, n_grams`` for every document.

    ``n_links``: other documents with Jaccard similarity of at least ``threshold`` over distinct
    word n-grams, copies included. ``copy_id``: smallest id with the same n-gram set.
    ``class_id``: smallest id of the connected component of the links.

    Defined results: words are runs of ``[^\\x20\\x09-\\x0D]``; a text of fewer than ``n`` words
    is one n-gram; a null text, or one without a word, links to nothing and is its own class;
    rows that share an id are one document (its smallest text) and one row; rows without an id
    are left out; further columns are ignored; an empty table gives none.
    """
    bands = band_count(float(threshold), band_rows, recall)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).filter("id IS NOT NULL")
    if not docs.groupBy("id").count().filter("count > 1").isEmpty():
        docs = docs.groupBy("id").agg(F.min("t").alias("t"))
    sk = materialise(sketches(docs, "t", "id", n, bands, band_rows), "sketch")
    has = sk.filter("g1 IS NOT NULL")
    reps = materialise(has.groupBy("g1", "g2", "n_grams").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by("bands", "id").alias("bands")), "reps")

    banded = reps.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "low")
    ties = banded.join(materialise(buckets, "buckets"), "band").filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    groups = materialise(components(ties, "candidates"), "groups")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))

    # Deal components to units of work: small ones by hash, large ones by pairs of blocks.
    n_units = max(1, -(-groups.count() // UNIT_ROWS))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.when(F.col("size") <= BLOCK, F.array(F.struct(F.lit(-1).cast("long").alias("c"), F.pmod(F.xxhash64("root"), F.lit(n_units)).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))) \
        .otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(
            F.col("root").alias("c"), F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"),
            F.when(k < F.col("block"), 1).otherwise(0).alias("side"))))
    dealt = (groups.join(materialise(sizes, "sizes"), "root").withColumn("block", block)
             .select("node", "root", pairs.alias("units")))
    members = dealt.join(reps.select(F.col("rep").alias("node"), "copies"), "node")
    sets = _gram_sets(docs.select(F.col("id").alias("node"), "t").join(members, "node"), n)
    work = sets.withColumn("u", F.explode("units")).select("node", "root", "copies", "grams", "u.*")

    def verify(unit: pa.Table) -> pa.Table:
        root = unit["root"].to_numpy()
        order = np.argsort(root, kind="stable")
        ids, copies, side = (unit[c].to_numpy() for c in ("node", "copies", "side"))
        grams = unit["grams"].combine_chunks()
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            sets = [np.frombuffer(grams[int(r)].as_buffer(), np.uint64) for r in rows]
            out.append(_verify(ids[rows], copies[rows], sets, side[rows], threshold))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
        return pa.table({"node": cols[0], "links": cols[1], "local": cols[2]})

    checked = materialise(work.groupBy("c", "i", "j").applyInArrow(verify, "node long, links long, local long"), "links")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("node").alias("a"), F.col("local").alias("b")), "classes")
    per_rep = materialise(
        reps.select(F.col("rep").alias("node"), "g1", "g2", "n_grams", "copies").join(links, "node", "left").join(classes, "node", "left")
        .select("g1", "g2", "n_grams", F.col("node").alias("copy_id"), F.coalesce("root", "node").alias("class_id"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    none = sk.filter("g1 IS NULL").select("id", F.col("id").alias("copy_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_grams")
    return (has.select("id", "g1", "g2", "n_grams").join(per_rep, ["g1", "g2", "n_grams"])
            .select("id", "copy_id", "class_id", "n_links", "n_grams").unionByName(none).withColumnRenamed("id", id_col))

