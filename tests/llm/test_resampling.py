import collections
import hashlib
import math
import random
import zlib

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vellum.llm import queries as Q
from vellum.llm import resampling
from vellum.llm import textspans as ts

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, w + [a + " " + b for a, b in zip(w, w[1:])]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def brute(rows, target, share=25, least=20):
    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out, able = [], []
    for i, x in rows:
        words, f = features(x)
        weight = sum(gain[bucket(a)] for a in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(f), weight, score))
        if len(words) >= least:
            able.append((-score, -1 if i is None else i, len(out) - 1))
    rank = {k: r + 1 for r, (_, _, k) in enumerate(sorted(able)[:share * len(able) // 100])}
    return [(*o, rank.get(k)) for k, o in enumerate(out)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_buckets_match_plain_checksums():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abZ09é日 .\n-_") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["", "x" * 70_000 + " y", "a " + "z" * 5001]
    for part in ts.chunks(pa.array(texts), 9000):
        one, d1, two, d2 = resampling.feature_buckets(part)
        for i in range(part.n):
            words, f = features(texts[part.lo + i])
            assert one[d1 == i].tolist() == [bucket(w) for w in words]
            assert two[d2 == i].tolist() == [bucket(b) for b in f[len(words):]]


def test_query_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RUN_ROWS", 25)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = [tuple(r) for r in Q.QUERIES["op13_importance_resampling"](spark, SF_SMALL).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, target), key=key)


def test_odd_rows(spark, odd_docs, odd_texts, empty_docs, monkeypatch):
    monkeypatch.setattr(resampling, "RUN_ROWS", 6)
    target = spark.createDataFrame([(1, "w1 w2 w3 café"), (2, None), (3, "")], "item_id long, text string")
    hot = odd_docs.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))
    docs = odd_docs.unionByName(odd_docs.filter("doc_id IN (5, 8)"))
    for _ in range(40):
        docs = docs.unionByName(hot)  # one key holds a third of all rows
    texts = odd_texts + [(i, dict(odd_texts)[i]) for i in (5, 8)] + [(None, dict(odd_texts)[4])] * 40
    got = [tuple(r) for r in resampling.resample(docs, target).collect()]
    assert sorted(got, key=key) == sorted(brute(texts, ["w1 w2 w3 café", None, ""]), key=key)
    assert resampling.resample(empty_docs, target).count() == 0
    none = [tuple(r) for r in resampling.resample(odd_docs, empty_docs).collect()]
    assert sorted(none, key=key) == sorted(brute(odd_texts, []), key=key)


@pytest.mark.parametrize("values", ["same", "skewed"])
def test_sample_sort_ranks_exactly_in_balanced_segments(spark, values, monkeypatch, tmp_path):
    n = 3000
    x = F.lit(5) if values == "same" else F.floor(F.pow(F.rand(3), 8) * 50)
    spark.range(n).select(x.cast("long").alias("x"), F.col("id").alias("uid")).write.parquet(str(tmp_path / "t"))
    seen = []
    keep = resampling.materialise
    monkeypatch.setattr(resampling, "materialise", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    rows = resampling.sample_sort(spark.read.parquet(str(tmp_path / "t")), ["x", "uid"], run_rows=200).collect()
    assert [(r["rank"]) for r in sorted(rows, key=lambda r: (r["x"], r["uid"]))] == list(range(1, n + 1))
    sizes = [r["count"] for r in seen[-1].groupBy("_segment").count().collect()]
    assert len(sizes) >= 14 and max(sizes) <= 2 * n / 15
