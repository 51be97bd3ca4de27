import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vellum.llm import piece_codec
from vellum.llm import queries as Q

ALPHABET = [*"abcdefthe  \n\t12é日本▁,.", "</s>", "<0x0A>", "the ", "ing ", "\0", "😀", "    ", "﻿", "́", "\r\n", "ﬁ", "​"]


@pytest.fixture(scope="module")
def model():
    return Q.tokenizer_path(Q.PIECE_MODEL)


@pytest.fixture(scope="module")
def vocab(model):
    return piece_codec.pieces(model)


def test_ids_and_texts_match_the_library(vocab):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(6000)]
    texts += ["", " ", "x" * 5000, " " * 700, "a b " * 900, "▁", "\n"]
    ids, bounds = vocab.ids(texts)
    decoded = vocab.texts(ids, bounds)
    for i, known in enumerate(vocab.library.encode(texts)):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == known and decoded[i] == vocab.library.decode(known)


def test_any_ids_decode_as_in_the_library(vocab):
    rng = random.Random(4)
    runs = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 9))] for _ in range(4000)]
    bounds = np.append(0, np.cumsum([len(r) for r in runs]))
    got = vocab.texts(np.array([i for r in runs for i in r], np.int64), bounds)
    assert got == [vocab.library.decode(r) for r in runs]


def test_agenda_takes_the_best_score_then_the_leftmost():
    m = piece_codec.Merges({p: -float(k) for k, p in enumerate(["bc", "ab", "aa", "cc", "bcc"])})
    spelled = lambda t: [m.symbols[s] for s in m.merge(t)[0]]
    assert spelled("abc") == ["a", "bc"] and spelled("abcc") == ["a", "bcc"] and spelled("aaaaa") == ["aa", "aa", "a"]
    assert m.merge("") == ([], []) and m.merge("xab") == ([-1, m.number["ab"]], [0, 1])
    halves = {}
    assert m.merge("abd", frozenset([m.number["ab"]]), halves)[1] == [0, 2]
    assert halves == {m.number["ab"]: (m.number["a"], m.number["b"])}
    ties = piece_codec.Merges({"ab": -1.0, "bc": -1.0, "cd": 0.0})
    assert [ties.symbols[s] for s in ties.merge("abcbcd")[0]] == ["ab", "c", "b", "cd"]


def test_round_trip_of_odd_rows(spark, odd_docs, odd_texts, empty_docs, model, vocab):
    twice = odd_docs.unionByName(odd_docs.filter("doc_id IN (4, 15)")).unionByName(odd_docs.filter("doc_id = 15").withColumn("doc_id", F.lit(None).cast("long")))
    rows = piece_codec.round_trip(twice, model).collect()
    count = collections.Counter(r["doc_id"] for r in rows)
    assert count[4] == count[15] == 2 and count[None] == 1 and len(count) == len(odd_texts) + 1
    texts = dict(odd_texts) | {None: dict(odd_texts)[15]}
    for r in rows:
        known = vocab.library.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == known and r["n_tokens"] == len(known) and r["agrees"]
        assert r["decoded"] == vocab.library.decode(known)
    assert piece_codec.round_trip(empty_docs, model).count() == 0


def test_query_matches_the_library(spark, vocab):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = Q.QUERIES["op11_piece_codec"](spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        known = vocab.library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(known) and r["agrees"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, known)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(vocab.library.decode(known).encode()).hexdigest()
