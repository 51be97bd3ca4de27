"""BPE encoding and decoding with a distinct-word table.

Texts are split into words in Arrow batches. A block (a few megabytes of whole documents)
sends each of its distinct words once to the word's shard; the shard encodes each distinct
word once, whatever the number of blocks that hold it, and sends the ids back. The block
puts them in place by word position. Decoding joins the ids in use to the vocabulary's
id-to-piece table (broadcast: its size is the vocabulary's) and concatenates the pieces of
each document before the bytes become text.

What moves is one entry per (block, distinct word), not one per word: a word that makes up
a third of all text is one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vellum.llm import pretokens as pt
from vellum.llm import textspans as ts
from vellum.llm.lineage import materialise

SHARD_ROWS = 2048  # documents per shard of the word table


def _pack(codes: np.ndarray) -> bytes:
    """Compressed uint32s, by byte planes (small codes are the frequent ones)."""
    return zstandard.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Block:
    """One chunk of documents: its distinct words by shard, and the codes of all its words.

    Codes number the distinct words from the most frequent on; ``place[code]`` is the word's
    position in the list sorted by shard and first occurrence, in which ids come back.
    """

    def __init__(self, part: ts.Chunk, ids: pa.Array, vocab: pt.Vocabulary, shards: int):
        w = pt.words(part, vocab)
        inverse, contents = ts.codes(part.data, w.start, w.end)
        count = np.bincount(inverse, minlength=len(contents))
        spelled = np.fromiter(map(xxhash.xxh3_64_intdigest, contents.to_pylist()), np.uint64, len(contents))
        self.shard = (spelled % np.uint64(shards)).astype(np.int32)
        order = np.argsort(self.shard, kind="stable")
        rank = np.argsort(-count, kind="stable")
        code = np.empty(len(rank), np.int64)
        code[rank] = np.arange(len(rank))
        position = np.empty(len(order), np.int64)
        position[order] = np.arange(len(order))
        self.place, self.codes = position[rank], code[inverse]
        self.counts = np.bincount(w.doc, minlength=part.n)
        self.words = contents.take(pa.array(order)).cast(pa.binary())
        self.shard = self.shard[order]
        # Name of the block from its contents, the same whenever its rows are read again.
        whole = xxhash.xxh3_128()
        for numbers in (*ts.utf8_buffers(ids.cast(pa.string())), part.off, part.data):
            whole.update(np.ascontiguousarray(numbers))
        self.name = int.from_bytes(whole.digest()[:8], "little", signed=True)


def _words_by_shard(path: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pt.vocabulary(path)
        for batch in batches:
            for part in ts.chunks(batch.column(1)):
                b = _Block(part, batch.column(0).slice(part.lo, part.n), vocab, shards)
                if len(b.words):
                    first = np.flatnonzero(np.append(True, b.shard[1:] != b.shard[:-1]))
                    last = np.append(first[1:], len(b.words))
                    data, off = ts.utf8_buffers(b.words)
                    spelled = [zstandard.compress(data[off[i]:off[j]].tobytes(), 3) for i, j in zip(first, last, strict=True)]
                    sizes = [_pack(np.diff(off[i:j + 1])) for i, j in zip(first, last, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(b.shard[first]), pa.array(np.full(len(first), b.name)), pa.array(spelled), pa.array(sizes)], names=["shard", "block", "words", "lengths"])
    return run


def _codes_by_block(path: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pt.vocabulary(path)
        for batch in batches:
            for part in ts.chunks(batch.column(1)):
                ids = batch.column(0).slice(part.lo, part.n)
                b = _Block(part, ids, vocab, shards)
                row = [pa.array([b.name]), pa.ListArray.from_arrays(pa.array([0, part.n], pa.int32()), ids),
                       pa.array([b.counts.tolist()], pa.list_(pa.int64())), pa.array([_pack(b.place)]), pa.array([_pack(b.codes)])]
                yield pa.RecordBatch.from_arrays(row, names=["block", "ids", "counts", "place", "codes"])
    return run


def _encode_shard(path: str):
    """Ids of a shard's words: each distinct word encoded once, returned to every block that holds it."""
    def run(group: pa.Table) -> pa.Table:
        vocab = pt.vocabulary(path)
        lengths = [_unpack(x) for x in group["lengths"].to_pylist()]
        text = b"".join(map(zstandard.decompress, group["words"].to_pylist()))
        bounds = np.append(0, np.cumsum(np.concatenate(lengths)))
        coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(text)]).dictionary_encode()
        spelled = coded.dictionary.to_pylist()
        found = pt.encode_words(vocab, spelled)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        begin = np.cumsum(size) - size
        index = np.asarray(coded.indices).astype(np.int64)
        out_size = size[index]
        ids = flat[ts.ragged(begin[index], out_size)].astype("<u4")
        per_row = np.append(0, np.cumsum([len(x) for x in lengths]))
        ends = np.append(0, np.cumsum(out_size))[per_row]
        rows = range(len(lengths))
        return pa.table({
            "block": group["block"], "shard": group["shard"],
            "sizes": pa.array([_pack(out_size[per_row[i]:per_row[i + 1]]) for i in rows], pa.binary()),
            "tokens": pa.array([_pack(ids[ends[i]:ends[i + 1]]) for i in rows], pa.binary()),
            "used": pa.array([np.unique(ids[ends[i]:ends[i + 1]]).astype(np.int32) for i in rows], pa.list_(pa.int32()))})
    return run


def _assemble(id_type: pa.DataType):
    """Put a block's ids in place by position, and its pieces in place by id."""
    def run(docs: pa.Table, parts: pa.Table) -> pa.Table:
        sizes_of = {s: (a, t) for s, a, t, i in zip(parts["shard"].to_pylist(), parts["sizes"].to_pylist(), parts["tokens"].to_pylist(), parts["id"].to_pylist(), strict=True) if i is None}
        blobs = [sizes_of[s] for s in sorted(sizes_of)]
        size = np.concatenate([_unpack(a) for a, _ in blobs]) if blobs else np.zeros(0, np.int64)
        flat = np.concatenate([_unpack(t) for _, t in blobs]) if blobs else np.zeros(0, np.int64)
        begin = np.cumsum(size) - size
        table = parts.filter(pc.is_valid(parts["id"]))
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        known = table["id"].to_numpy()[order].astype(np.int64)
        piece, p_off = ts.utf8_buffers(table["piece"].combine_chunks().take(pa.array(order)).cast(pa.binary()))
        out = []
        for row in range(docs.num_rows):
            place, codes = _unpack(docs["place"][row].as_py()), _unpack(docs["codes"][row].as_py())
            if len(place) != len(size):
                raise RuntimeError("a block's rows changed between two reads of the input")
            word = place[codes]
            tokens = flat[ts.ragged(begin[word], size[word])]
            counts = np.array(docs["counts"][row].as_py(), np.int64)
            w_end = np.append(0, np.cumsum(size[word]))
            t_off = w_end[np.append(0, np.cumsum(counts))]
            at = np.searchsorted(known, tokens)
            p_len = np.diff(p_off)[at]
            text = piece[ts.ragged(p_off[at], p_len)].tobytes()
            b_off = np.append(0, np.cumsum(p_len))[t_off]
            ids = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer((t_off * 4).astype(np.int64)), pa.py_buffer(tokens.astype("<u4"))]).cast(pa.binary())
            decoded = pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(b_off[:-1].tolist(), b_off[1:].tolist(), strict=True)], pa.string())
            out.append(pa.table({"id": pa.array(docs["ids"][row].as_py(), id_type), "n_tokens": pa.array(np.diff(t_off)), "ids": ids, "decoded": decoded}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], id_type), "n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "decoded": pa.array([], pa.string())})
    return run


def pieces(spark, tokenizer: str) -> DataFrame:
    """The vocabulary's ``id, piece`` table."""
    return spark.createDataFrame(pt.Vocabulary(tokenizer).pieces(), "id int, piece binary")


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``id_col, n_tokens, ids, decoded`` for every row of ``docs``.

    ``ids`` are the tokenizer file's ids (no special tokens added, no truncation) as
    little-endian unsigned 32-bit integers; ``decoded`` is what those ids decode to, special
    tokens included. ``tokenizer`` is a path that every executor can read.

    Defined results: a null text is empty and has no ids; repeated rows are encoded row by
    row; a null id is kept; further columns are ignored; an empty table gives an empty one.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    shards = max(16, src.count() // shard_rows)
    id_type = src.schema["id"].dataType
    words = src.mapInArrow(_words_by_shard(tokenizer, shards), "shard int, block long, words binary, lengths binary")
    coded = materialise(words.groupBy("shard").applyInArrow(_encode_shard(tokenizer), "block long, shard int, sizes binary, tokens binary, used array<int>"), "words")
    vocab = F.broadcast(pieces(docs.sparkSession, tokenizer))  # bounded by the vocabulary
    used = coded.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("used"))).alias("used"))
    spelled = used.select("block", F.explode("used").alias("id")).join(vocab, "id")
    parts = coded.select("block", "shard", "sizes", "tokens").unionByName(spelled, allowMissingColumns=True)
    blocks = src.mapInArrow(_codes_by_block(tokenizer, shards), T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("place", T.BinaryType()), T.StructField("codes", T.BinaryType())]))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    out = blocks.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(_assemble(to_arrow_type(id_type)), schema)
    return out.withColumnRenamed("id", id_col)
