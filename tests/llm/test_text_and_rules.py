import re

import pyarrow as pa

from vellum.llm import quality_rules as Q
from vellum.llm import textspans as ts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_word_and_line_spans_match_regex(odd_texts):
    texts = [t for _, t in odd_texts]
    seen = 0
    for part in ts.chunks(pa.array(texts, pa.string()), 3000):
        raw = part.data.tobytes()
        for spans, expected in ((ts.word_spans(part), lambda t: WORD.findall(t)), (ts.line_spans(part), lambda t: t.split("\n"))):
            got = [[] for _ in range(part.n)]
            for a, b, d in zip(*spans, strict=True):
                got[d].append(raw[a:b].decode())
            assert got == [expected(t or "") for t in texts[part.lo:part.lo + part.n]]
        seen += part.n
    assert seen == len(texts)


def test_sliced_and_null_columns():
    column = pa.array(["a", None, "bc", "", "d"]).slice(1, 3)
    (part,) = ts.chunks(column)
    assert part.data.tobytes() == b"bc" and part.off.tolist() == [0, 0, 2, 2]


def _expected(text):
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    again = {i + k for i, g in enumerate(tri) if tri.count(g) > 1 for k in range(3)} if len(w) < 5000 else None
    lines, seen, dup = [x for x in t.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, None if again is None else len(again)


def test_measurements_match_brute_force(odd_docs, odd_texts):
    rows = {r["doc_id"]: r for r in Q.apply_policy(Q.ledger(odd_docs)).collect()}
    assert len(rows) == len(odd_texts)
    for i, text in odd_texts:
        r, e = rows[i], _expected(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == e[:4], i
        assert e[4] is None or r["n_repeat_words"] == e[4], i
    assert rows[0]["fail_bits"] & Q.BIT["few_words"] and not rows[0]["kept"]
    assert rows[4]["kept"] and rows[8]["kept"] and not rows[19]["kept"]


def test_ablation_counts_what_each_rule_removes(odd_docs):
    rows = Q.ledger(odd_docs)
    bits = [r["fail_bits"] for r in rows.collect()]
    for r in Q.ablation(rows).collect():
        mask, bit = Q.POLICIES[r["policy"]], Q.BIT[r["rule"]]
        assert r["n_docs"] == len(bits)
        assert r["n_kept"] == sum(b & mask == 0 for b in bits)
        assert r["n_fail"] == sum(b & bit != 0 for b in bits)
        assert r["n_only"] == sum(b & mask == bit for b in bits)


def test_ledger_of_empty_and_repeated_rows(empty_docs, odd_docs):
    assert Q.ledger(empty_docs).count() == 0
    twice = Q.ledger(odd_docs.unionByName(odd_docs)).groupBy("doc_id").count()
    assert {r["count"] for r in twice.collect()} == {2}
