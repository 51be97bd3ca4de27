"""Hand-made edge cases for the column functions (Python-regex semantics on Spark)."""

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import textops as TO
from vellum.operators import tokens as TK


def one(spark, values, fn, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


def test_segment_hashtags(spark):
    got = one(spark, ["#ClimateChangeNow", "#climateChange", "#COP26", "##x", "a#b c", "#ClimateChange2", "#Ééanon"],
              T.segment_hashtags)
    assert got == ["Climate Change Now", "climateChange", "COP26", "#x", "ab c", "Climate Change 2", "Ééanon"]


def test_mentions_urls_unicode(spark):
    assert one(spark, ["hi @jürgen there"], T.strip_mentions) == ["hi  there"]
    assert one(spark, ["a http://x.y/z b www.q.org c wwwxabc"], T.strip_urls) == ["a  b  c "]
    # NBSP and other Unicode spaces count as whitespace, as in Python's \s
    assert one(spark, ["a   b\n\tc "], T.collapse_whitespace) == ["a b c"]


def test_clean_social_order(spark):
    got = one(spark, ["@bob <b>#HelloWorld</b>   see http://x.io now"], T.clean_social)
    assert got == ["Hello World see now"]


def test_word_tokens(spark):
    got = one(spark, ["Don't stop, well-known U.S. 2020 cannot café's end."], T.word_tokens)
    assert got == [["do", "n't", "stop", ",", "well-known", "u.s", ".", "2020", "can", "not", "café", "'s", "end", "."]]
    assert one(spark, [""], T.word_tokens) == [[]]
    assert one(spark, [None], T.word_tokens) == [None]
    filt = one(spark, ["Don't stop, well-known U.S. 2020 cannot café's end."],
               lambda c: T.filter_tokens(T.word_tokens(c)))
    assert filt == [["stop", "café", "end"]]


def test_filter_tokens_extra_stop(spark):
    got = one(spark, ["the th nd quick brown er fox"], lambda c: T.filter_tokens(T.word_tokens(c), extra=True))
    assert got == [["quick", "brown", "fox"]]


def test_truncate_and_sentences(spark):
    assert one(spark, ["a b c d", "a b", "  ", ""], lambda c: T.truncate_words(c, 3)) == ["a b c...", "a b", "", ""]
    assert one(spark, ["One. Two! Three? Four.  Five"], T.sentence_pairs) == ["One. Two!<br>Three? Four.<br>Five"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(TK.ngrams("t")).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["x"], []]


def test_chunks_edges(spark):
    L = 4
    texts = ["", " ".join(["w"] * (L - 1)), " ".join(["w"] * L), " ".join(f"t{i}" for i in range(L + 1)),
             " ".join(f"t{i}" for i in range(2 * L + 1))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, Text string")
    for mode, expect in {"classic": [1, 1, 1, 1, 1], "longform": [1, 1, 1, 2, 3], "snapshot": [1, 1, 1, 2, 2]}.items():
        rows = TO.chunk_tokens(df, mode, L).groupBy("doc_id").count().orderBy("doc_id").collect()
        assert [r["count"] for r in rows] == expect, mode
        counts = TO.count_chunks(df, mode, L, per_doc=True).orderBy("doc_id").collect()
        assert [r["n_chunks"] for r in counts] == expect, mode
    snap = TO.chunk_tokens(df.filter("doc_id = 4"), "snapshot", L).orderBy("chunk_no").collect()
    assert [r["chunk_text"] for r in snap] == ["t0 t1", "t7 t8"]


def test_map_labels(spark):
    df = spark.createDataFrame([("left",), ("1",), ("2.0",)], "lab string")
    got = [r[0] for r in TO.map_labels(df, "lab", {"left": 0, 1: 1, 2: 2}).select("label").collect()]
    assert got == [0, 1, 2]
    same = [r[0] for r in TO.map_labels(df, "lab", {}).select("label").collect()]
    assert same == ["left", "1", "2.0"]
    bad = spark.createDataFrame([("zzz",)], "lab string")
    assert TO.map_labels(bad, "lab", {"a": 0}, strict=False).first()["label"] is None
    import pytest
    with pytest.raises(Exception):
        TO.map_labels(bad, "lab", {"a": 0}).collect()


def test_parse_time(spark):
    from vellum.operators.report import parse_time, time_parse_report
    df = spark.createDataFrame([("2020-01-02",), ("Apr 06 22:19:45 PDT 2009",), ("Mon Apr 06 22:19:45 PDT 2009",),
                                ("junk",), ("",), (None,)], "Time string")
    p = parse_time(df).select(F.date_format("Parsed_Time", "yyyy-MM-dd HH:mm:ss").alias("t")).collect()
    assert [r[0] for r in p] == ["2020-01-02 00:00:00", "2009-04-07 05:19:45", "2009-04-07 05:19:45", None, None, None]
    rep = time_parse_report(parse_time(df)).first()
    assert (rep["n_parsed"], rep["n_unparsed"]) == (3, 3)


def test_parse_time_shapes(spark):
    from vellum.operators.report import parse_time
    cases = {"2020-01-02T03:04:05Z": "2020-01-02 03:04:05.000", "2020-01-02 03:04": "2020-01-02 03:04:00.000", "Jan 2, 2020": "2020-01-02 00:00:00.000",
             "Apr 6 2009": "2009-04-06 00:00:00.000", "2020-01-02 03:04:05.123": "2020-01-02 03:04:05.123", "03/04/2020": "2020-03-04 00:00:00.000",
             "2020-01-02T03:04:05+02:00": "2020-01-02 01:04:05.000", "25/12/2020": "2020-12-25 00:00:00.000", "2 January 2020": "2020-01-02 00:00:00.000",
             "Thu, 02 Jan 2020 03:04:05 +0000": "2020-01-02 03:04:05.000", "3/4/2020 5:06 PM": "2020-03-04 17:06:00.000", "2020/1/2": "2020-01-02 00:00:00.000"}
    df = spark.createDataFrame([(k,) for k in cases], "Time string")
    got = {r["Time"]: r["t"] for r in parse_time(df).select("Time", F.date_format("Parsed_Time", "yyyy-MM-dd HH:mm:ss.SSS").alias("t")).collect()}
    assert got == cases


def test_parse_time_custom_formats(spark):
    from vellum.operators.report import parse_time
    import pytest
    df = spark.createDataFrame([("05.06.2021 07h08",), ("2021-06-05",)], "Time string")
    for fmt in ("%d.%m.%Y %Hh%M", "dd.MM.yyyy HH'h'mm"):
        got = [str(r["Parsed_Time"]) for r in parse_time(df, custom=fmt).collect()]
        assert got == ["2021-06-05 07:08:00", "None"]
    with pytest.raises(ValueError):
        parse_time(df, custom="%Q")


def test_metadata(spark):
    from vellum.operators.tables import metadata_to_map
    df = spark.createDataFrame([(1, "Metadata\nkey: a: b\nother = v"), (2, "KEY: later\nbare words")],
                               "doc_id long, Metadata string")
    got = {r["key"]: r["value"] for r in metadata_to_map(df).collect()}
    assert got == {"key": "later", "other": "v"}


def test_replace_emojis(spark):
    got = one(spark, ["I 😀 it 👍👍"], lambda c: T.replace_emojis(c, {"😀": "grinning_face", "👍": "thumbs_up"}))
    assert got == ["I :grinning_face: it :thumbs_up::thumbs_up:"]


def test_streaming_columns(spark, tmp_path):
    """The column functions are stateless, so they run unchanged on a streaming frame."""
    src = tmp_path / "in"
    spark.createDataFrame([(1, "#HelloWorld @x see http://a.b")], "doc_id long, text string").write.parquet(str(src))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(src))
    assert stream.isStreaming
    q = (stream.select("doc_id", T.clean_social("text").alias("c")).writeStream.format("memory")
               .queryName("clean_stream_test").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    assert [r["c"] for r in spark.sql("select c from clean_stream_test").collect()] == ["Hello World see"]


def test_streaming_module(spark, tmp_path):
    from vellum.streaming.clean import start_clean_stream
    src = tmp_path / "src"
    spark.createDataFrame([(1, "The #QuickFox jumps"), (2, "<p>Hello there</p>")], "doc_id long, text string") \
        .write.parquet(str(src))
    q = start_clean_stream(spark, str(src), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r["doc_id"]: (r["clean"], list(r["tokens"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("The Quick Fox jumps", ["quickfox", "jumps"]), 2: ("Hello there", ["hello"])}
