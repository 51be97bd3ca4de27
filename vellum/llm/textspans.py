"""Vectorised text primitives over Arrow string columns.

The per-document operators read texts as the UTF-8 bytes Arrow already holds and work on
a few megabytes of whole documents at a time: words, lines and n-grams become integer
spans and 64-bit hashes, so no Python object is made per word. A chunk always holds whole
documents; its memory is bounded by ``CHUNK_BYTES`` or by one longer document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 4 << 20

# Separators of a "word": the class [\x20\x09-\x0D].
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so powers of it are invertible modulo 2**64
_MASK = (1 << 64) - 1


@dataclass
class Chunk:
    """Whole documents of a batch: rows ``lo .. lo + n``, ``data[off[i]:off[i + 1]]`` is text i."""

    lo: int
    data: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each document."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        """Index of the document that holds each byte position (positions ascending or not)."""
        return np.searchsorted(self.off, pos, side="right") - 1


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column into runs of whole documents of about ``limit`` bytes."""
    data, off = utf8_buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield Chunk(lo, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        lo = hi


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the runs ``[start, start + length)``, one after the other."""
    begin = np.cumsum(length) - length
    return np.repeat(start - begin, length) + np.arange(int(length.sum()))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixer (two multiply-xorshift rounds) over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**i, base**-i) modulo 2**64 for i < n, kept between chunks."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, b & _MASK, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of ``code(symbol) * base**i``; differences give the hash of any span."""
    up, _ = _powers(len(symbols) + 1)
    codes = _byte_codes()[symbols] if symbols.dtype == np.uint8 else mix64(symbols.astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(codes * up[:len(symbols)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of spans ``[start, end)``; equal contents hash alike wherever they stand.

    For features and for spans of a few hundred bytes: a polynomial modulo 2**64 gives some
    pairs of spans of 1,024 bytes and more the same hash. Words and lines of any length are
    compared by ``codes`` or ``digests``.
    """
    _, down = _powers(len(prefix))
    h = (prefix[end] - prefix[start]) * down[start]
    return mix64(h ^ ((end - start).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)))


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code, contents): spans numbered by their bytes, in order of first occurrence; exact."""
    size = end - start
    if len(start) and not (start[1:] == end[:-1]).all():
        data = data[ragged(start, size)]
    elif len(start):
        data = data[start[0]:end[-1]]
    off = np.append(0, np.cumsum(size)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """xxhash of the bytes of each span; each distinct span is hashed once."""
    code, contents = codes(data, start, end)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, contents.to_pylist()), np.uint64, len(contents))[code]


def word_spans(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of ``[^\\x20\\x09-\\x0D]`` bytes."""
    return runs(chunk, ~_SPACE[chunk.data])


def runs(chunk: Chunk, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of marked bytes in one text."""
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = chunk.off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]  # texts that meet without a space between
    first[cuts] = True
    last[cuts - 1] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, chunk.doc_of(start)


def line_spans(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each ``\\n``-split line; an empty text has one empty line."""
    breaks = np.flatnonzero(chunk.data == 0x0A)
    doc = chunk.doc_of(breaks)
    starts = np.concatenate([chunk.off[:-1], breaks + 1])
    docs = np.concatenate([np.arange(chunk.n), doc])
    order = np.lexsort((starts, docs))
    starts, docs = starts[order], docs[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.flatnonzero(np.append(docs[1:] != docs[:-1], True))
    ends[last] = chunk.off[docs[last] + 1]
    return starts, ends, docs


def ngram_hash(word_hash: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every window of ``n`` words inside one document, in word order."""
    if len(word_hash) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(word_hash) - n + 1
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc = acc * np.uint64(_BASE) + word_hash[k:k + m]
    same = doc[:m] == doc[n - 1:]
    return mix64(acc[same]), doc[:m][same]
