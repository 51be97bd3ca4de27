"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised by the vocabulary's own rules and cut into segments between neighbouring
characters that no piece of the vocabulary holds side by side. Merges never cross such a cut,
so a segment's ids depend on the segment alone. Each distinct segment of an
Arrow batch is encoded once: an agenda (heap) holds the adjacent symbol pairs that spell a
piece, the best score first and the leftmost among equals; taking a pair joins its symbols and
puts the two new neighbours on the agenda. Symbols that are no piece fall back to byte pieces.
Ids then go in place by segment position, and pieces by id.

Every Arrow batch is checked against the sentencepiece library (``agrees``). Rows stay where
they are: there is no shuffle, and a task holds one chunk of whole documents and a bounded
cache of segments.
"""

from __future__ import annotations

import codecs
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vellum.llm import textspans as ts

MARK = "▁"  # stands for a space
CACHE_SEGMENTS = 1 << 18  # segments a worker remembers between batches, about; twice as many at most
CACHE_LENGTH = 64  # longer segments (characters) are not remembered

codecs.register_error("vellum-byte", lambda e: ("�", e.start + 1))


class Merges:
    """Which symbols join into which: pieces and single characters are numbered symbols.

    ``rank`` maps a pair of symbols, written ``left * m + right``, to the place of the piece it
    spells by descending score (equal scores, equal places), ``made`` to that piece.
    """

    def __init__(self, score: dict[str, float]):
        place = {x: k for k, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.symbols = list(dict.fromkeys([*score, *(c for p in score for c in p)]))
        self.number = {s: i for i, s in enumerate(self.symbols)}
        self.m = len(self.symbols) + 1  # so that no pair's key meets that of a pair with an unknown character (-1)
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for p, x in score.items():
            for i in range(1, len(p)):
                a, b = self.number.get(p[:i]), self.number.get(p[i:])
                if a is not None and b is not None:
                    self.rank[a * self.m + b] = place[x]
                    self.made[a * self.m + b] = self.number[p]

    def merge(self, text: str, unused: frozenset[int] = frozenset(), halves: dict | None = None) -> tuple[list[int], list[int]]:
        """Symbols of one segment, and where each begins: adjacent pairs join by score, the leftmost first among equals.

        The agenda holds ``rank * n + left`` of each pair; an entry is stale when the symbols at
        its place have grown or gone since, so that they spell another rank. Symbols in
        ``unused`` may be passed through but not kept: ``halves`` gets the last pair that
        spelled each. Characters of no piece are symbol -1.
        """
        n, m, get, push, pop = len(text), self.m, self.rank.get, heapq.heappush, heapq.heappop
        number = self.number.get
        sym = [number(c, -1) for c in text]
        agenda = []
        for i in range(n - 1):
            found = get(sym[i] * m + sym[i + 1])
            if found is not None:
                agenda.append(found * n + i)
                if unused and self.made[sym[i] * m + sym[i + 1]] in unused:
                    halves[self.made[sym[i] * m + sym[i + 1]]] = (sym[i], sym[i + 1])
        heapq.heapify(agenda)
        before, after = list(range(-1, n)), list(range(1, n + 1))  # n: no neighbour on the right
        while agenda:
            found, left = divmod(pop(agenda), n)
            right = after[left]
            if right == n or sym[left] is None:
                continue
            key = sym[left] * m + sym[right]
            if get(key) != found:
                continue
            sym[left], sym[right] = self.made[key], None
            after[left] = right = after[right]
            before[right] = left
            for a, b in ((left, right), (before[left], left)):
                if a >= 0 and b < n:
                    key = sym[a] * m + sym[b]
                    found = get(key)
                    if found is not None:
                        push(agenda, found * n + a)
                        if unused and self.made[key] in unused:
                            halves[self.made[key]] = (sym[a], sym[b])
        at = [i for i, s in enumerate(sym) if s is not None]
        return [sym[i] for i in at], at


class Pieces:
    """A sentencepiece model file: pieces, scores, and the segments encoded so far."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = range(sp.vocab_size())
        self.piece = [sp.id_to_piece(i) for i in kinds]
        byte = {i for i in kinds if sp.is_byte(i)}
        silent = {i for i in kinds if sp.is_control(i)}
        plain = [i for i in kinds if i not in byte and i not in silent and not sp.is_unknown(i)]
        words = {self.piece[i]: i for i in plain}
        self.merges = Merges({p: sp.get_score(i) for p, i in words.items()})
        self.id_of = [words.get(s, -1) for s in self.merges.symbols] + [-1]  # the last for unknown characters
        self.unused = frozenset(self.merges.number[self.piece[i]] for i in plain if sp.is_unused(i))
        self.unknown = sp.unk_id()
        self.byte_id = {int(self.piece[i][1:-1], 16): i for i in byte} if len(byte) == 256 else {}
        # Neighbouring characters that some piece holds together; merges cross no other border.
        inner = sorted({c for p in words if len(p) > 1 for c in p})
        self.place = np.zeros(0x110000, np.uint16)
        self.place[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.joins = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for p in words:
            at = self.place[[ord(c) for c in p]]
            self.joins[at[:-1], at[1:]] = True
        # What each id decodes to.
        unk = sp.decode([self.unknown]).encode()
        text = [bytes([int(self.piece[i][1:-1], 16)]) if i in byte else b"" if i in silent else unk if sp.is_unknown(i)
                else self.piece[i].replace(MARK, " ").encode() for i in kinds]
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.length = np.array([len(t) for t in text], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        # A text's first piece gives up one space when the vocabulary puts one before each text.
        dummy, usual = sp.normalize("a").startswith(MARK), set(plain)
        self.opens = np.array([dummy and i in usual and self.piece[i].startswith(MARK) for i in kinds])
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def segment(self, text: str) -> list[int]:
        """Ids of one segment."""
        halves: dict[int, tuple[int, int]] = {}
        symbols, at = self.merges.merge(text, self.unused, halves)
        if halves:
            symbols, at = self._apart(symbols, at, halves)
        ids = [self.id_of[s] for s in symbols]
        if -1 not in ids:
            return ids
        out: list[int] = []
        for i, k in zip(ids, at, strict=True):
            if i >= 0:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in text[k].encode()]
            else:
                out.append(self.unknown)
        return out

    def _apart(self, symbols: list[int], at: list[int], halves: dict[int, tuple[int, int]]) -> tuple[list[int], list[int]]:
        """Symbols with the unused ones taken apart again into the pairs that formed them."""
        todo, out = list(zip(symbols, at, strict=True))[::-1], []
        while todo:
            s, k = todo.pop()
            if s in halves:
                a, b = halves[s]
                todo += [(b, k + len(self.merges.symbols[a])), (a, k)]
            else:
                out.append((s, k))
        return [s for s, _ in out], [k for _, k in out]

    def encode(self, segments: list[str]) -> list[bytes]:
        """Ids (as uint32s) of distinct segments, from the cache where they were met before."""
        out = []
        for s in segments:
            ids = self._cache.get(s)
            if ids is None:
                ids = self._older.get(s)
                if ids is None:
                    ids = array("I", self.segment(s)).tobytes()
                if len(s) <= CACHE_LENGTH:
                    self._cache[s] = ids
            out.append(ids)
        if len(self._cache) > CACHE_SEGMENTS:  # the segments met since the last change stay
            self._older, self._cache = self._cache, {}
        return out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids of all texts in one array, and where each text's ids begin and end."""
        data, off = ts.utf8_buffers(pa.array([self.library.normalize(t) for t in texts], pa.large_string()))
        start = np.zeros(len(data) + 1, bool)
        at = self.place[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        first = np.flatnonzero((data & 0xC0) != 0x80)
        start[first[1:][~self.joins[at[:-1], at[1:]]]] = True
        start[off] = True
        cut = np.flatnonzero(start)
        begin = cut[:-1] if len(data) else np.zeros(0, np.int64)
        segments = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        found = self.encode(segments.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32).astype(np.int64)
        index = np.asarray(segments.indices).astype(np.int64)
        first = (np.cumsum(size) - size)[index]
        total = np.append(0, np.cumsum(size[index]))
        return flat[ts.ragged(first, size[index])], total[np.searchsorted(begin, off)]

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """What each run of ids decodes to; bytes that are no UTF-8 become U+FFFD one by one."""
        length, begin = self.length[ids], self.begin[ids]
        # The space before a text: its first id with any text gives it up.
        seen = np.append(0, np.cumsum(length > 0))
        lead = np.searchsorted(seen, seen[bounds[:-1]] + 1) - 1
        lead = lead[(lead < bounds[1:]) & (seen[bounds[1:]] > seen[bounds[:-1]])]
        lead = lead[self.opens[ids[lead]]]
        length[lead] -= 1
        begin[lead] += 1
        raw = self.bytes[ts.ragged(begin, length)].tobytes()
        at = np.append(0, np.cumsum(length))[bounds].tolist()
        out = [raw[a:b].decode("utf-8", "vellum-byte") for a, b in zip(at[:-1], at[1:], strict=True)]
        # Bytes on either side of a control piece make no character together.
        ends = np.append(0, np.cumsum(length))
        for i in np.unique(np.searchsorted(bounds, np.flatnonzero(self.length[ids] == 0), "right") - 1).tolist():
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            cut = ends[[lo, *(lo + np.flatnonzero(self.length[ids[lo:hi]] == 0)), hi]].tolist()
            out[i] = "".join(raw[a:b].decode("utf-8", "vellum-byte") for a, b in zip(cut[:-1], cut[1:], strict=True))
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _round_trip(path: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(path)
        for batch in batches:
            for part in ts.chunks(batch.column(1)):
                rows = batch.slice(part.lo, part.n)
                texts = rows.column(1).to_pylist()
                ids, bounds = vocab.ids(texts)
                decoded = vocab.texts(ids, bounds)
                known = vocab.library.encode(texts, num_threads=1)
                back = vocab.library.decode(known)
                size = np.diff(bounds)
                known_size = np.fromiter(map(len, known), np.int64, len(known))
                if np.array_equal(size, known_size) and np.array_equal(ids, np.fromiter(chain.from_iterable(known), np.int64, int(known_size.sum()))):
                    agrees = [a == b for a, b in zip(decoded, back, strict=True)]
                else:
                    agrees = [a == b and ids[lo:hi].tolist() == k for a, b, lo, hi, k in zip(decoded, back, bounds[:-1].tolist(), bounds[1:].tolist(), known, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    rows.column(0).cast(id_type), pa.array(size), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], names=["id", "n_tokens", "ids", "decoded", "agrees"])
    return run


def round_trip(docs: DataFrame, model: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, ids, decoded, agrees`` for every row of ``docs``.

    ``ids`` are the ids that ``model`` (a sentencepiece file of merge type, at a path that every
    executor can read) gives the whole text, without begin or end ids and without sampling;
    ``decoded`` is what they decode to. ``agrees`` says whether the sentencepiece library gives
    the same ids and the same decoded text: it is false where the vocabulary is of another type.

    Defined results: a null text is empty and has no ids; repeated rows are encoded row by row;
    a null id is kept; further columns are ignored; an empty table gives an empty one.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    id_type = src.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType()), T.StructField("agrees", T.BooleanType())])
    return src.mapInArrow(_round_trip(model, to_arrow_type(id_type)), schema).withColumnRenamed("id", id_col)
