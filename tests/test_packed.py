"""Packed features: the same numbers as one row per term, without a row per term in joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import ablation as AB
from vellum.operators import packed as P
from vellum.operators import scoring as SC
from vellum.operators import textops as TO
from vellum.operators import tokens as TK
from vellum.operators import train as TR
from vellum.operators.common import unit_hash


@pytest.fixture()
def rows(spark):
    # An id that repeats, a null id, a document without a known term, and one without any.
    return spark.createDataFrame([(1, ["b", "a", "b"]), (1, ["a", "é"]), (2, ["c", "zz"]), (None, ["a", "c", "c"]), (3, ["zz"]), (4, None), (5, [])],
                                 "doc_id long, tokens array<string>")


@pytest.fixture()
def model(spark):
    w = [(k, t, 0.5 * i - 0.3 * k * (i + 1)) for i, t in enumerate(["a", "b", "c", "é"]) for k in range(2)]
    return spark.createDataFrame(w, "class_no int, term string, w double"), spark.createDataFrame([(0, -0.5), (1, -0.9)], "class_no int, b double")


@pytest.fixture()
def packed(rows, model):
    vocab = P.terms_of(model[0].select("term").distinct().toArrow())
    counts = rows.select("doc_id", P.counted("tokens", vocab).alias("c")).select("doc_id", "c.term", "c.n")
    return P.with_shares(counts).select("doc_id", "term", "x")


def _set(df):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v
    return sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str)


def test_counts_keep_the_row(rows, packed):
    counts = rows.select("doc_id", P.counted("tokens").alias("c")).select("doc_id", "c.term", "c.n")
    got = {(r["doc_id"], tuple(r["term"]), tuple(r["n"])) for r in counts.collect()}
    assert got == {(1, ("a", "b"), (1, 2)), (1, ("a", "é"), (1, 1)), (2, ("c", "zz"), (1, 1)), (None, ("a", "c"), (1, 2)),
                   (3, ("zz",), (1,)), (4, (), ()), (5, (), ())}
    shares = {(r["doc_id"], r["term"]): r["x"] for r in P.unpack(packed.filter("doc_id IS NULL")).collect()}
    assert shares == {(None, "a"): 1 / 3, (None, "c"): 2 / 3}


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_packed_scores_equal_joined_scores(monkeypatch, rows, model, packed, limit):
    monkeypatch.setattr(P, "BROADCAST_ROWS", limit)  # 1: the tables are joined
    w, b = model
    docs, long = rows.select("doc_id"), P.unpack(packed)
    var = w.select("class_no", "term", F.abs("w").alias("variance"))
    for run in (lambda f: SC.score_probabilities(f, w, b, docs, 2),
                lambda f: SC.softmax_uncertainty(f, w, b, var, None, docs, 2, consider_bias=False),
                lambda f: SC.mc_dropout(f, w, b, docs, 2, n_samples=4, p=0.4),
                lambda f: SC.mc_dropout_scores(f, w.filter("class_no = 1").select("term", "w"), 0.25, docs, n_samples=4, p=0.4)):
        assert _set(run(packed)) == _set(run(long))


def test_packed_gradients_equal_joined_gradients(spark, rows, model, packed):
    w, b = model
    scored = SC.score_probabilities(packed, w, b, rows.select("doc_id"), 2)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, None)], "doc_id long, label int")
    batches = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, batch long")
    (gw, gb), (lw, lb) = SC.batch_gradients(packed, scored, labels, batches, 2), SC.batch_gradients(P.unpack(packed), scored, labels, batches, 2)
    assert gw.count() == 2 and _set(gb) == _set(lb)  # one row a batch, not one a term
    cols = ["class_no", "term", "fim"]
    assert _set(SC.fisher_accumulate(gw, 2).select(cols)) == _set(SC.fisher_accumulate(lw, 2).select(cols))
    state, known = TR.initial_state(w.select("term").distinct(), 2, w, b), labels.filter("label IS NOT NULL")
    logs = [_set(TR.train_fisher_adam(f, known, w.select("term").distinct(), 2, known.select("doc_id"), known.select("doc_id"), epochs=1, n_batches=1, init=state)[0])
            for f in (packed, P.unpack(packed))]
    assert logs[0] == logs[1]


def test_packed_curve_equals_joined_curve(spark, model, packed):
    w, b = model
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, label int")
    ranks = spark.createDataFrame([(t, i) for i, t in enumerate(["c", "a", "é", "b"])], "term string, rank long")
    curves = [_set(AB.f1_vocabulary_retention(f, labels, w, b, ranks, 2, 0.25)) for f in (packed, P.unpack(packed))]
    assert curves[0] == curves[1] and len(curves[0]) == 5


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 1.0])
def test_masks_are_those_of_the_hash(spark, p):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("té").alias("term"))
    prefix = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(""))
    same = SC._keeps(prefix, F.col("term"), 3, p, 42) == (unit_hash(F.col("doc_id"), F.col("term"), F.lit(3), F.lit(42)) >= F.lit(p))
    assert df.filter(~same).count() == 0


def test_steps_run_where_their_text_is(spark):
    texts = ["a  <b>x</b>\t y\n", " \x85 x", "I can't; we'll, CANNOT.", "cannot can not n't's", "", None, "x < y", "e.g. 3.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.lower("t")
    for pattern, repl, _ in T.TOKEN_STEPS:
        plain = F.regexp_replace(plain, pattern, repl)
    for got, want in ((T.token_text("t"), plain), (T.collapse_whitespace("t"), F.trim(F.regexp_replace("t", T.WS + "+", " "))),
                      (T.strip_html("t"), F.regexp_replace("t", "<[^>]+>", ""))):
        assert df.filter(~got.eqNullSafe(want)).count() == 0


def test_chunks_split_a_text_once(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10))))], "doc_id long, Text string")
    chunks = TO.chunk_tokens(df, "longform", 4)
    assert [r["chunk_text"] for r in chunks.orderBy("chunk_no").collect()] == ["0 1 2 3", "4 5 6 7", "8 9"]
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


TEXTS = [(1, "The cat's cat -- don't  cannot cannot; a<b>zé É</b>\n\tZÉ. U.S. naïve.) 日本語 x2 _y ſ"), (1, "cat\u2028dog\u00a0dog"),
         (2, "the and 12 ..."), (None, "Dog (dog)--DOG [cat] wouldn't"), (3, ""), (4, None)]


def _words(spark, repeat=1):
    rows = spark.createDataFrame(TEXTS * repeat, "doc_id long, text string")
    return rows, rows.select("doc_id", TK.counted_tokens("text").alias("c")).select("doc_id", "c.words", "c.n")


def test_words_are_counted_without_an_array_of_tokens(spark):
    rows, got = _words(spark)
    want = rows.select("doc_id", P.counted(TK.filtered_tokens(F.col("text"))).alias("c")).select("doc_id", "c.term", "c.n")
    assert dict(got.dtypes) == {"doc_id": "bigint", "words": "string", "n": "array<int>"}
    assert [(r["doc_id"], r["words"].split(), r["n"]) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert _set(P.unpack_words(got).select("doc_id", "term", "n")) == _set(P.unpack(want, ("term", "n")).select("doc_id", "term", "n"))
    stats = P.unpack(want, ("term", "n")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))
    assert _set(P.word_frequencies(got)) == _set(stats)


@pytest.mark.parametrize("limit", [4_000_000, 1])
def test_places_give_what_names_give(monkeypatch, spark, limit):
    monkeypatch.setattr(P, "PLACED_ROWS", limit)  # 1: the tables are joined
    _, rows = _words(spark, 2)
    known = P.pa.array(["cat", "dog", "naïve", "日本語"])
    totals = P.with_totals(rows.select("doc_id", P.placed("words", "n", known).alias("c")).select("doc_id", "c.term", "c.n"))
    assert dict(totals.dtypes)["term"] == "array<int>"
    placed = P.shares(totals).select("doc_id", "term", "x")
    names = placed.withColumn("term", P.named("term", known))
    w = spark.createDataFrame([(k, i, 0.4 * i - 0.7 * k) for i in range(4) for k in range(2)], "class_no int, term int, w double")
    at = spark.createDataFrame([(t,) for t in known.to_pylist()], "name string").select("name", P.place_of("name", known).alias("term"))
    by_name = w.join(at, "term").select("class_no", F.col("name").alias("term"), "w")
    b = spark.createDataFrame([(0, -0.5), (1, -0.9)], "class_no int, b double")
    docs, labels = rows.select("doc_id"), spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, label int")
    batches = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, batch long")
    scores = [SC.score_probabilities(f, v, b, docs, 2) for f, v in ((placed, w), (names, by_name))]
    assert _set(scores[0]) == _set(scores[1])
    fim = [SC.fisher_accumulate(SC.batch_gradients(f, s, labels, batches, 2)[0], 2) for f, s in zip((placed, names), scores, strict=True)]
    assert fim[0].count() > 0
    assert _set(fim[0].join(at, "term").select("class_no", "name", "fim")) == _set(fim[1].select("class_no", "term", "fim"))
    var = w.select("class_no", "term", F.abs("w").alias("variance")), by_name.select("class_no", "term", F.abs("w").alias("variance"))
    assert _set(SC.softmax_uncertainty(placed, w, b, var[0], None, docs, 2, consider_bias=False)) == _set(
        SC.softmax_uncertainty(names, by_name, b, var[1], None, docs, 2, consider_bias=False))


def test_the_model_moves_places_not_names(spark):
    from tests.conftest import SF_SMALL
    from vellum.plans.model_fixture import lang_model
    m = lang_model(spark, SF_SMALL)
    assert dict(m.coded.dtypes)["term"] == "array<int>" and dict(m.coded_weights.dtypes)["term"] == "int"
    names = [r["term"] for r in m.places.orderBy("place").collect()]
    assert names == sorted(r["term"] for r in m.vocab.collect()) == [r["term"] for r in m.named(m.places.withColumn("term", F.col("place"))).orderBy("place").collect()]
    assert {tuple(r) for r in m.weights.select("class_no", "term", "w").collect()} == {
        (r["class_no"], names[r["term"]], r["w"]) for r in m.coded_weights.collect()}


def test_a_model_beyond_the_limit_gives_the_same_scores(monkeypatch, spark):
    from tests.conftest import SF_SMALL
    from vellum.plans import model_fixture as MF
    monkeypatch.setattr(MF, "_CACHE", {})
    got = []
    for limit in (4_000_000, 1):
        monkeypatch.setattr(P, "PLACED_ROWS", limit)
        MF._CACHE.clear()
        m = MF.lang_model(spark, SF_SMALL)
        assert (m.places is None) == (limit == 1) and P.is_packed(m.coded) == (limit > 1)
        got.append([_set(SC.score_probabilities(m.coded, m.coded_weights, m.bias, m.docs.select("doc_id"), MF.K)),
                    _set(m.weights.select("class_no", "term", "w")), _set(m.features.select("doc_id", "term", "n", "x"))])
    assert got[0] == got[1]


def test_shared_counts_keep_every_term_that_the_share_keeps(spark):
    """Terms of long form and of packed places agree, with rows that repeat an id, without one, or without terms."""
    from vellum.operators import features as FE
    from vellum.operators import tokens as TK
    rng = np.random.default_rng(6)
    rows = [(i % 55 if i % 9 else None, [f"w{int(t)}" for t in rng.zipf(1.4, rng.integers(0, 40)) if t < 400]) for i in range(60)] + [(70, [None, "w1"]), (71, None)]
    df = spark.createDataFrame(rows, "doc_id long, terms array<string>").repartition(7).localCheckpoint()
    for least in (0.02, 0.1, 0.3):
        counts, vocab = TK.shared_counts(df, "terms", least, len(rows))
        want = FE.tfidf(TK.term_counts(df.withColumn("terms", F.expr("filter(terms, x -> x IS NOT NULL)")), F.col("terms")), min_df=least, max_df=0.57, n_docs=len(rows))
        got = FE.tfidf(counts, min_df=least, max_df=0.57, n_docs=len(rows), vocab=vocab)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        a, b = (sorted((str(r["doc_id"]), r["term"], r["tf"], round(r["idf"], 9), round(r["w"], 9)) for r in t.collect()) for t in (got, want))
        assert a == b and a
    assert TK.shared_counts(df, "terms", 0.001, len(rows)) is None and TK.shared_counts(df.limit(0), "terms", 0.1, 0) is None


def test_tfidf_shuffles_no_row_per_term(spark):
    from tests.conftest import SF_SMALL
    from vellum.plans.catalog import QUERIES
    p = QUERIES["tfidf"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in p and p.index("Generate") < p.index("Exchange")  # terms are taken apart above the last exchange
