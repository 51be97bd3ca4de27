"""Words of a byte-level BPE tokenizer, found without a regex engine.

The public pattern of the vocabulary (``PATTERN``) is evaluated over arrays of code points:
runs of letters, numbers, other characters and white space, one space joined to the run
after it, and the seven contractions. Special tokens cut the text first, as the tokenizers
library does, and are words of their own. ``tests/llm`` holds the result against the library.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from vellum.llm import textspans as ts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task one core

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_OTHER, _LETTER, _NUMBER, _BLANK = range(4)


class CodePoints:
    """Class of code points (letter, number, white space, other) as the tokenizers library sees them.

    The library's Unicode tables are not Python's, so a code point is looked up in the library
    the first time it occurs: it has a class if it stays in one piece after a member of it.
    """

    def __init__(self, tokenizer):
        self._split = tokenizer.pre_tokenizer.pre_tokenize_str
        self._known = np.full(0x110000, 255, np.uint8)

    def of(self, code: np.ndarray) -> np.ndarray:
        kind = self._known[code]
        if (kind == 255).any():
            new = np.unique(code[kind == 255])
            self._known[new] = _BLANK
            for member, name in (("a", _LETTER), ("1", _NUMBER), ("!", _OTHER)):
                pieces = self._split("".join(f"{member}{chr(c)}\n" for c in new.tolist()))
                alone = np.zeros(3 * len(new), bool)
                alone[[a for _, (a, _b) in pieces]] = True
                self._known[new[~alone[1::3]]] = name
            kind = self._known[code]
        return kind


@dataclass
class Words:
    """Words of a chunk in text order: byte spans, document, and the index of a special token or -1."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    special: np.ndarray


def _specials(part: ts.Chunk, tokens: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, index) of the special tokens that stand whole in one document, leftmost first."""
    raw = part.data.tobytes() if tokens else b""
    if not any(t in raw for t in tokens):
        z = np.zeros(0, np.int64)
        return z, z, z
    found = [(m.start(), m.end(), tokens.index(m.group())) for m in regex.finditer(b"|".join(regex.escape(t) for t in sorted(tokens, key=lambda t: (-len(t), t))), raw, overlapped=True)]
    out, reach = [], 0
    for a, b, k in found:
        if a >= reach and part.doc_of(np.array([a]))[0] == part.doc_of(np.array([b - 1]))[0]:
            out.append((a, b, k))
            reach = b
    cols = np.array(out, np.int64).reshape(-1, 3)
    return cols[:, 0], cols[:, 1], cols[:, 2]


def words(part: ts.Chunk, vocab: Vocabulary) -> Words:
    """Split every text of a chunk."""
    data = part.data
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(z, z, z, z)
    if (data < 0x80).all():
        at, code = np.arange(len(data)), data
    else:
        at = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = vocab.code_points.of(code)
    n = len(code)
    s_start, s_end, s_kind = _specials(part, vocab.special_tokens)

    cut = np.zeros(n + 1, bool)  # a text, or a part between special tokens, begins here
    inner = np.concatenate([part.off, s_start, s_end])
    cut[np.searchsorted(at, inner)] = True
    cut[0] = cut[n] = True
    run = cut[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = kind == _BLANK
    space = code == 0x20

    start = run.copy()
    # A run after a space in the same text takes that space, which begins the word instead.
    start[1:] &= ~(~blank[1:] & space[:-1] & ~cut[1:n])
    # The last blank before something else in the same text is split from the blanks before it.
    start[:-1] |= blank[:-1] & ~blank[1:] & ~cut[1:n]

    quote = np.flatnonzero((code == 0x27) & start & run)
    if len(quote):
        edge = np.flatnonzero(cut)
        left = edge[np.searchsorted(edge, quote, "right")] - quote
        c1, c2 = code[np.minimum(quote + 1, n - 1)], code[np.minimum(quote + 2, n - 1)]
        two = (left > 1) & np.isin(c1, [ord(c) for c in "stmd"])
        three = (left > 2) & ~two & (((np.isin(c1, [ord("r"), ord("v")])) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l"))))
        for q, size in ((quote[two], 2), (quote[three], 3)):
            start[q + 1] = False
            rest = q + size
            rest = rest[~cut[rest]]
            start[rest[kind[rest] == _LETTER]] = True

    begin = at[np.flatnonzero(start)]
    if len(s_start):
        inside = np.searchsorted(s_start, begin, "right") - 1
        begin = begin[(inside < 0) | (begin >= s_end[inside]) | (begin == s_start[inside])]
    end = np.append(begin[1:], len(data))
    special = np.full(len(begin), -1, np.int64)
    if len(s_start):
        special[np.searchsorted(begin, s_start)] = s_kind
    return Words(begin, end, part.doc_of(begin), special)


class Vocabulary:
    """A tokenizer file: its library tokenizer, special tokens and pieces."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.tokenizer = Tokenizer.from_file(path)
        self.code_points = CodePoints(self.tokenizer)

    @property
    def special_tokens(self) -> tuple[bytes, ...]:
        return tuple(self.special)

    @property
    def special_ids(self) -> np.ndarray:
        return np.array(list(self.special.values()), np.int64)

    def pieces(self) -> list[tuple[int, bytes]]:
        """(id, bytes) of every token."""
        byte_of = {c: b for b, c in byte_letters().items()}
        out = {i: t for t, i in self.special.items()}
        out.update({i: bytes(byte_of[c] for c in token) for token, i in self.vocab.items() if i not in out})
        return sorted(out.items())


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_words(vocab: Vocabulary, spelled: list[bytes]) -> list[list[int]]:
    """Ids of single words, special tokens included, by the tokenizers library's BPE model."""
    letters, merge, special = byte_letters(), vocab.tokenizer.model.tokenize, vocab.special
    return [[special[w]] if w in special else [t.id for t in merge(w.decode("latin-1").translate(letters))] for w in spelled]
