"""Sources, sinks and table shaping."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.sources import documents as SD


def test_read_csv_multiline(spark, tmp_path):
    p = tmp_path / "docs.csv"
    p.write_text('id,text,src\n1,"line one\nline ""two""",a\n2,plain,b\n')
    df = SD.read_documents(spark, str(p), "csv")
    rows = sorted((r["id"], r["text"]) for r in df.collect())
    assert rows == [("1", 'line one\nline "two"'), ("2", "plain")]
    with pytest.raises(Exception):
        SD.read_documents(spark, str(tmp_path / "missing.csv"), "csv").collect()


def test_config_and_normalise(spark, tmp_path):
    cfg_path = tmp_path / "cfg.json"
    cfg_path.write_text(json.dumps({"mine": {"text_field": "t", "source_field": "", "time_field": "when"}}))
    cfg = SD.load_config(str(cfg_path), "mine")
    with pytest.raises(ValueError):
        SD.load_config(str(cfg_path), "other")
    df = spark.createDataFrame([(1, "hello", 5)], "doc_id long, t string, n int")
    out = SD.normalise_documents(df, cfg).first()
    assert (out["Text"], out["Source"], out["Time"]) == ("hello", "Unknown", "")
    with pytest.raises(ValueError):
        SD.normalise_documents(df, {"text_field": "nope"})


def test_union_and_attach(spark):
    a = spark.createDataFrame([(1, "x")], "doc_id long, Text string")
    b = spark.createDataFrame([(1, "y")], "doc_id long, Text string")
    assert SD.union_sources(None, None) is None
    u = SD.union_sources(a, b).orderBy("origin").collect()
    assert [(r["origin"], r["Text"]) for r in u] == [(0, "x"), (1, "y")]
    res = spark.createDataFrame([(1, 0.5, "new")], "doc_id long, score double, Text string")
    got = SD.attach_results(a, res).first()
    assert got["Text"] == "new" and got["score"] == 0.5


def test_write_and_variance_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "doc_id long, v string")
    path = SD.write_results(df, str(tmp_path / "out"))
    assert spark.read.parquet(path).count() == 1
    var = spark.createDataFrame([("weight", 0, "t", 2.0)], "param string, class_no int, term string, variance double")
    base = str(tmp_path / "var")
    SD.save_variance(var, base, "v1")
    SD.save_variance(var.withColumn("variance", F.lit(3.0)), base, "v2")
    assert SD.load_variance(spark, base, "v1").first()["variance"] == 2.0
    assert SD.load_variance(spark, base, "v2").first()["variance"] == 3.0
    assert SD.load_variance(spark, str(tmp_path / "none"), "v1") is None
    assert SD.load_variance(spark, base, "v3") is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception):
        SD.load_variance(spark, str(tmp_path / "broken"), "v1")


def test_results_can_replace_the_table_they_read(spark, tmp_path):
    path = str(tmp_path / "docs")
    SD.write_results(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, v string"), path)
    for k in range(2):
        SD.write_results(spark.read.parquet(path).withColumn(f"c{k}", F.lit(k)), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a", 0, 1), (2, "b", 0, 1)]
    broken = spark.read.parquet(path).select(F.raise_error(F.lit("stop")).alias("x"))
    with pytest.raises(Exception):
        SD.write_results(broken, path)
    assert spark.read.parquet(path).count() == 2
    assert [p.name for p in tmp_path.iterdir() if "old" in p.name] == []


def test_weighted_and_seeded_splits(spark):
    d = spark.range(0, 2000).withColumnRenamed("id", "doc_id")
    n = {r["split"]: r["count"] for r in SD.split_documents(d, weights={"a": 1, "b": 1, "c": 2}).groupBy("split").count().collect()}
    assert set(n) == {"a", "b", "c"} and abs(n["c"] - 1000) < 120 and abs(n["a"] - 500) < 100
    one, two = ({r["doc_id"] for r in SD.split_documents(d, seed=s).filter("split = 'test'").collect()} for s in (1, 2))
    assert one != two and abs(len(one) - 400) < 90


def test_split_is_deterministic(spark):
    d = spark.range(0, 500).withColumnRenamed("id", "doc_id")
    a = {r["doc_id"] for r in SD.select_split(d, "test").collect()}
    b = {r["doc_id"] for r in SD.select_split(d.repartition(7), "test").collect()}
    assert a == b and 50 < len(a) < 150


def test_top_bottom_two_columns_and_truncation(spark):
    from vellum.operators.report import top_bottom_table
    rows = [(i, " ".join(["w"] * 60), i / 10, 1 - i / 10, None if i == 0 else i * 1.0) for i in range(6)]
    wide = spark.createDataFrame(rows, "doc_id long, Text string, `Probability Distribution 1: neg` double, "
                                       "`Probability Distribution 2: pos` double, `continuous: score` double")
    t = top_bottom_table(wide, n=2)
    cols = {r["column_name"] for r in t.collect()}
    assert cols == {"Probability Distribution 1: neg", "continuous: score"}
    top = [r["doc_id"] for r in t.filter("column_name = 'continuous: score' AND Category = 'Top Scores'").collect()]
    low = [r["doc_id"] for r in t.filter("column_name = 'continuous: score' AND Category = 'Lowest Scores'").collect()]
    assert sorted(top) == [4, 5] and sorted(low) == [1, 2]          # the NULL score is excluded
    assert all(r["Text"].endswith("...") and len(r["Text"].split(" ")) == 48 for r in t.collect())
