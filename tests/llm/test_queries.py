"""Every operator's query against its SQL, and the pipeline against a brute-force version."""

import pytest

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_dedup import brute_links, repeats
from tests.llm.test_tokens import check_pieces
from vellum.llm import lineage, quality_rules
from vellum.llm import queries as Q

PATTERN = r"AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_its_sql(spark, name):
    from vellum.plans.verify import _norm, duck
    df = Q.QUERIES[name](spark, SF_SMALL)
    result = duck(SF_SMALL).execute(Q.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(map(_norm, r))) for r in result.fetchall()) == sorted(repr(tuple(_norm(r[c]) for c in names)) for r in df.collect())


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
    import __spark_entry__
    assert {*Q.QUERIES, "pipeline"} <= set(__spark_entry__.queries())


def test_pipeline_matches_brute_force(spark, tokenizer):
    import regex
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.apply_policy(quality_rules.ledger(docs)).filter("kept").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept)
    cls = brute_links(rows)[2]
    rows = [(i, t) for i, t in rows if cls[i] == i]
    marks = repeats([(i, t.encode()) for i, t in rows])
    texts = {}
    for i, t in rows:
        left = bytes(b for b, m in zip(t.encode(), marks[i], strict=True) if not m).decode("utf-8", "ignore")
        if left:
            texts[i] = regex.sub(PATTERN, "[SECRET]", left)
    pieces = corpus_pipeline.run(spark, SF_SMALL).collect()
    check_pieces([r.asDict() for r in pieces], texts, Tokenizer.from_file(tokenizer))


def test_stages_keep_columns_and_odd_rows(spark, odd_docs, empty_docs):
    docs = odd_docs.unionByName(odd_docs.filter("doc_id IN (4, 8)"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = lineage.materialise(stage(spark, docs, SF_SMALL), "test")
        assert out.columns == odd_docs.columns, name
        none = stage(spark, empty_docs, SF_SMALL)
        assert none.columns == empty_docs.columns and none.count() == 0
        docs = out
    assert docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    assert docs.filter("`odd name` <> 'extra odd name'").isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() >= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, empty_docs, SF_SMALL).count() == 0
