import hashlib
import re

import pytest

from vellum.llm import lineage, ngram_join, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(rows, n=100):
    """Brute force over (order, bytes): removed flags per document."""
    seen, out = set(), {}
    for key, b in rows:
        mark, end = bytearray(len(b)), 0
        for s in range(len(b) - n + 1):
            h = hashlib.md5(b[s:s + n]).digest()
            if h in seen:
                for i in range(max(s, end), s + n):
                    mark[i] = 1
                end = s + n
            else:
                seen.add(h)
        out[key] = mark
    return out


def check(df, rows):
    expected = repeats([(i, (t or "").encode()) for i, t in rows])
    texts = dict(rows)
    got = {r["doc_id"]: r for r in df.collect()}
    assert set(got) == set(texts)
    for i, mark in expected.items():
        b, r = (texts[i] or "").encode(), got[i]
        assert bytes(r["kept"]) == bytes(x for x, m in zip(b, mark, strict=True) if not m), i
        assert r["n_bytes"] == len(b) and r["n_removed"] == sum(mark)
        flags = bytearray(len(b))
        for s in r["spans"]:
            for k in range(s["start"], s["stop"]):
                flags[k] = 1
        assert flags == mark
        assert all(a["stop"] < b_["start"] for a, b_ in zip(r["spans"], r["spans"][1:], strict=False))


def test_repeated_spans_match_brute_force(odd_docs, odd_texts):
    short = [(i, t) for i, t in odd_texts if i != 9 and i != 8] + [(8, (odd_texts[8][1])[:20_000]), (9, odd_texts[9][1][:20_500])]
    df = odd_docs.sparkSession.createDataFrame(short, "doc_id long, text string")
    check(suffix_dedup.remove_repeats(df), short)


def test_repeats_across_chunks_and_seeds(spark, odd_texts):
    rows = [(i, t) for i, t in odd_texts if i >= 100 or i in (4, 5, 10, 11, 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(suffix_dedup.remove_repeats(df, seed=16), rows)


def test_repeated_and_missing_ids_are_documents_of_their_own(spark, odd_texts):
    base = odd_texts[4][1]
    df = spark.createDataFrame([(1, base), (1, base), (None, base + " end"), (2, "short")], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df).collect()
    assert len(rows) == 4
    # Rows without an id come first in order, so the copies under id 1 both go.
    assert sorted((r["doc_id"] or 0, len(r["kept"]) > 0) for r in rows) == [(0, True), (1, False), (1, False), (2, True)]


def test_remove_repeats_keeps_columns_and_empty_tables(odd_docs, empty_docs):
    out = suffix_dedup.remove_repeats(odd_docs.filter("doc_id < 7"))
    assert [c for c in odd_docs.columns if c not in ("spans", "kept")] + ["n_bytes", "n_removed", "spans", "kept"] == out.columns
    assert out.filter("`odd name` = 'extra odd name'").count() == 7
    assert suffix_dedup.remove_repeats(empty_docs).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(empty_docs, seed=100)


def grams(text, n=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_links(rows):
    g = {i: grams(t) for i, t in rows}
    near = {i: {j for j in g if j != i and g[i] and g[j] and 9 * len(g[i] & g[j]) >= 4 * (len(g[i]) + len(g[j]))} for i in g}
    cls = {}
    for i in sorted(g):
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in cls:
                cls[k] = i
                stack += near[k]
    return g, near, cls


@pytest.mark.parametrize("block", [512, 8])
def test_join_matches_brute_force(odd_docs, odd_texts, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    g, near, cls = brute_links(odd_texts)
    rows = ngram_join.similarity_join(odd_docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(g)
    for r in rows:
        i = r["doc_id"]
        assert (r["n_links"], r["class_id"], r["n_grams"]) == (len(near[i]), cls[i], len(g[i])), i
        assert r["copy_id"] == min(j for j in g if j == i or (g[j] and g[j] == g[i]))


def test_join_of_repeated_missing_and_no_rows(odd_docs, empty_docs, odd_texts):
    some = odd_docs.filter("doc_id IN (4, 5, 100)")
    twice = some.unionByName(some)
    rows = ngram_join.similarity_join(twice).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == [(4, 4, 2), (5, 4, 2), (100, 4, 2)]
    missing = odd_docs.sparkSession.createDataFrame([(None, odd_texts[4][1]), (4, odd_texts[4][1])], "doc_id long, text string")
    assert [tuple(r)[:4] for r in ngram_join.similarity_join(missing).collect()] == [(4, 4, 4, 0)]
    assert ngram_join.similarity_join(empty_docs).count() == 0


def test_band_count_reaches_the_recall():
    b = ngram_join.band_count(0.8, 5, 0.99995)
    assert 1 - (1 - 0.8 ** 5) ** b >= 0.99995 > 1 - (1 - 0.8 ** 5) ** (b - 1)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, k) for k in range(1001, 1100)]
    found = {r["node"]: r["root"] for r in lineage.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert set(found) == {*range(301), *range(1000, 1100)}
    assert all(root == (0 if node < 301 else 1000) for node, root in found.items())
    with pytest.raises(RuntimeError):
        lineage.components(spark.createDataFrame(path, "a long, b long"), max_rounds=1)
