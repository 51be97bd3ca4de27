import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex

from vellum.llm import bpe_codec, packing
from vellum.llm import pretokens as pt
from vellum.llm import textspans as ts


@pytest.fixture(scope="module")
def library(tokenizer):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer)


ALPHABET = list("ab'sstlrevmd  \n\t 12!?<|.é") + ["<|endoftext|>", "　", "\xa0", "'ll", "'re", " ", "😀", "\r\n", "Ᲊ", "՘", "࢏", "\x1f", "\x85", "​", "٠", "²", "́"]


def test_words_match_the_library(library, tokenizer):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    vocab = pt.vocabulary(tokenizer)
    for part in ts.chunks(pa.array(texts), 3000):
        w, raw = pt.words(part, vocab), part.data.tobytes()
        got = [[] for _ in range(part.n)]
        for a, b, d in zip(w.start, w.end, w.doc, strict=True):
            got[d].append(raw[a:b].decode())
        for i in range(part.n):
            expected = []
            for piece in regex.split(r"(<\|endoftext\|>)", texts[part.lo + i]):
                expected += [piece] if piece == "<|endoftext|>" else [piece[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(piece)] if piece else []
            assert got[i] == expected


def test_round_trip_matches_the_library(spark, library, tokenizer, odd_docs, odd_texts):
    rng = random.Random(5)
    extra = [(1000 + k, "".join(rng.choice(ALPHABET) for _ in range(60))) for k in range(300)]
    df = odd_docs.select("doc_id", "text", "id", "t", "block").unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    rows = bpe_codec.round_trip(df, tokenizer, shard_rows=16).collect()
    texts = dict(odd_texts + extra)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_round_trip_of_repeated_rows_and_no_rows(odd_docs, empty_docs, tokenizer):
    some = odd_docs.filter("doc_id < 8")
    twice = bpe_codec.round_trip(some.coalesce(1).unionByName(some.coalesce(1)), tokenizer).collect()
    assert collections.Counter(r["doc_id"] for r in twice) == {i: 2 for i in range(8)}
    assert bpe_codec.round_trip(empty_docs, tokenizer).count() == 0


def check_pieces(rows, texts, library, window=1024):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            if "ids" in r:
                assert np.frombuffer(r["ids"], "<u4").tolist() == ids[at:at + r["length"]]
            else:
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for seq in sequences.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or (at < window and at & (at - 1) == 0)


def test_packing_holds_every_id_once(odd_docs, odd_texts, library, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    check_pieces([r.asDict() for r in packing.pack(odd_docs, tokenizer).collect()], dict(odd_texts), library)


def test_packing_of_no_rows_and_small_windows(empty_docs, odd_docs, tokenizer, library, odd_texts):
    assert packing.pack(empty_docs, tokenizer).count() == 0
    rows = packing.pack(odd_docs.filter("doc_id < 6"), tokenizer, window=64).collect()
    check_pieces([r.asDict() for r in rows], dict(odd_texts[:6]), library, 64)


def test_index_prefers_lexical_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.integers(0, 100, 60), rng.integers(200, 300, 60)]
    docs = [rng.permutation(topics[k % 2])[:50] for k in range(8)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=400)
    idf = np.maximum(np.log((100 - df + 0.5) / (df + 0.5)), 0)
    flat, off = np.concatenate(docs), np.append(0, np.cumsum([len(d) for d in docs]))
    s = packing.Index(flat, off, idf, 50.0).scores(0)
    assert min(s[2::2]) > max(s[1::2])
    sequences = list(packing.pack_documents(flat, off, idf, 50.0, 100))
    assert {p[0] % 2 for p in sequences[0]} == {0}
    assert sum(p[2] for q in sequences for p in q) == 400


def test_packing_finds_neighbours_in_every_block(spark, tokenizer, library, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 10)
    rng = random.Random(8)
    # Twenty families of four, each with words of its own; a block holds an eighth of all.
    texts = {}
    for k in range(20):
        own = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(30)]
        for i in range(4):
            texts[100 * i + k] = " ".join(rng.choice(own) for _ in range(40))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = [r.asDict() for r in packing.pack(docs, tokenizer, window=512).collect()]
    check_pieces(rows, texts, library, 512)
    members = collections.defaultdict(list)
    for r in rows:
        if r["start"] == 0:
            members[r["sequence_id"]].append(r["doc_id"] % 100)
    pairs = [(a, b) for m in members.values() for i, a in enumerate(m) for b in m[:i]]
    related = {i for m in members.values() for i in m if m.count(i) > 1}
    assert len(related) >= 18 and sum(a == b for a, b in pairs) > 0.4 * len(pairs)


def test_routing_keeps_near_copies_within_reach(spark, tokenizer, monkeypatch):
    """Recall of the best neighbour that fits, against a search of all documents, for seeds with a near copy."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(packing, "SHARD_DOCS", 12)
    rng = random.Random(9)
    rows, passage = [], " ".join(f"q{rng.randrange(900)}" for _ in range(40))
    for k in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(70)]
        for i in range(3):
            copy = list(base)
            copy[rng.randrange(70)] = f"edit{i}"
            rows.append((10 * k + i, " ".join(copy) + (" " + passage if k % 3 == 0 else "")))  # a third share a passage
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    tokens, idf, average, dtype, n = packing.prepare(docs, tokenizer)
    shards = {r["uid"]: r["shard"] for r in packing.routes(tokens, idf, dtype, n).collect()}
    assert n == len(rows) == len(shards) and max(collections.Counter(shards.values()).values()) < 24 and len(set(shards.values())) >= 14
    best = packing.best_fits(tokens, tokens.filter(F.col("id") % 10 == 0), idf, average, dtype).collect()
    near = [r for r in best if r["score"] >= 0.9 * r["self"]]
    assert len(near) >= 55 and np.mean([shards[r["seed"]] == shards[r["uid"]] for r in near]) >= 0.9
    ids = {r["uid"]: r["id"] for r in tokens.collect()}
    assert all(ids[r["seed"]] // 10 == ids[r["uid"]] // 10 for r in near)


def test_word_ids_outlive_a_change_of_the_cache(monkeypatch, tokenizer, library):
    """Words that are looked up in bulk keep their ids when the cache changes, and only new words are encoded."""
    vocab, asked, run = pt.Vocabulary(tokenizer), [], pt.encode_words
    monkeypatch.setattr(packing, "_CACHE_WORDS", 3)
    monkeypatch.setattr(pt, "encode_words", lambda v, words: asked.extend(words) or run(v, words))
    words = packing.WordIds(vocab)
    for text in ["one two", "", "two three four", " four one six", "é two two"]:
        ids, off = words.encode(next(ts.chunks(pa.array([text, "one", text]))))
        want = [library.encode(t, add_special_tokens=False).ids for t in (text, "one", text)]
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want
    assert asked.count(b"one") == 1 and isinstance(words.known.words, pa.Array)


def test_samples_of_a_sketch_read_distinct_tokens(monkeypatch):
    sketch, read, plain = packing.Sketcher(np.linspace(0.0, 3.0, 40)), [], packing._term_counts
    monkeypatch.setattr(packing, "_term_counts", lambda *a: read.append(plain(*a)) or read[-1])
    docs = [[5, 9, 5, 5, 30, 0], [0], [30, 9, 5, 0, 9]]
    values, lead = sketch(np.array(sum(docs, []), np.uint16), np.append(0, np.cumsum([len(d) for d in docs])))
    assert lead.tolist() == [min(int(sketch.rank[0][t]) for t in d) for d in docs]
    assert (values[0, packing.SHINGLE_VALUES:] == values[2, packing.SHINGLE_VALUES:]).all()
    assert read[0][1].tolist() == [0, 5, 9, 30, 0, 0, 5, 9, 30]
