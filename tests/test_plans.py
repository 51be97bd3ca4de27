"""Physical-plan properties the operators are designed for."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from vellum.plans.catalog import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_projection_reaches_the_scan(spark):
    p = plan(QUERIES["strip_html"](spark, SF_SMALL))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in p


def test_per_group_top_k_is_a_group_limit(spark):
    assert "WindowGroupLimit" in plan(QUERIES["top_words"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan(QUERIES["top_bottom_table"](spark, SF_SMALL))


def test_weights_are_broadcast(spark):
    assert "BroadcastHashJoin" in plan(QUERIES["score_probabilities"](spark, SF_SMALL))


def test_token_explode_has_no_inferred_scan_filter(spark):
    p = plan(QUERIES["word_tokens"](spark, SF_SMALL))
    assert "DataFilters: []" in p          # the tokeniser is not duplicated at the scan


def test_filter_pushdown(spark):
    df = spark.read.parquet(f"{SF_SMALL}/events.parquet").filter(F.col("event_type") == "click").select("event_id")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan(df)


def test_sample_is_the_first_ids_in_hash_order(spark):
    import hashlib
    from vellum.sources import documents as SD
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id")
    got = {r[0] for r in SD.sample_documents(df, 50, True, 7).collect()}
    ids = sorted((r[0] for r in df.collect()), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    assert got == set(ids[:50])


def test_term_counts_need_no_shuffle_however_the_table_is_stored(spark, tmp_path):
    from vellum.operators import tokens as TK
    one = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    one.repartition(24).write.parquet(str(tmp_path / "documents.parquet"))
    many = spark.read.parquet(str(tmp_path / "documents.parquet"))
    plans = [plan(TK.term_counts(TK.with_tokens(d, "text"), "tokens")) for d in (one, many)]
    assert not any("Exchange" in p for p in plans)
    counts = [sorted(map(tuple, TK.term_counts(TK.with_tokens(d, "text"), "tokens").collect())) for d in (one, many)]
    assert counts[0] == counts[1]


def test_plans_above_the_scan_do_not_depend_on_the_files(spark, tmp_path):
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(24).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("word_tokens", "ngrams", "tfidf", "build_vocabulary"):
        one, many = (plan(QUERIES[name](spark, d)) for d in (SF_SMALL, str(tmp_path)))
        exchanges = [[x.split("ENSURE")[0].split("#")[0] for x in p.split("\n") if "Exchange hash" in x or "Exchange range" in x] for p in (one, many)]
        assert exchanges[0] == exchanges[1]


def test_retention_schedule():
    from vellum.operators.evaluate import retention_schedule
    assert retention_schedule(0.1) == [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0]
    assert retention_schedule(0.5) == [1.0, 0.5, 0.0]
    assert retention_schedule((0.25, 0.1, 0.5)) == [1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0]
    assert retention_schedule((0.3, 0.1, 0.5)) == [1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0]
