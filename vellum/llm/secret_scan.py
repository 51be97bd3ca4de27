"""Secret scan with a random forest that removes false positives.

Candidates are runs of key-like characters and every value assigned to a credential name,
found by one regular expression, evaluated once; what stands between them gives the words around each. Features describe a
candidate's length, its character transitions (changes of class, and how likely its letter
pairs are in the corpus' words), its coverage by dictionary words, whether it is part of a
path or the document stands under a test path, and its neighbouring words. A random forest
learns from labelled findings which candidates are secrets. Everything on the path from
text to verdict is a column expression or MLlib's own transformer, so it runs in the JVM.

Words and letter pairs are counted over all documents; the dictionary is a table of every word
in a share ``WORD_SHARE`` of them, joined with the candidates' parts. Only labelled findings are
sampled: forest and neighbour table come from ``MAX_TRAIN`` distinct ones, chosen by hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.lineage import materialise

_NAME = r"(?i:passwor[dt]|passwd|passphrase|pwd|kennwort|mot[ _]de[ _]passe|contrase(?:ñ|n)a|token|secret(?:[_-]?access)?(?:[_-]?key)?|api[_-]?key|access[_-]?key)"
_ASSIGNED = _NAME + r"""["']?\s{0,3}[=:]\s{0,3}["']?"""
_RUN = r"[A-Za-z0-9_+/\-]"
#: The value of a credential name (in quotes: up to the closing one), the password of an address
#: (``scheme://user:password@host``); else a run that is no such name itself.
CANDIDATE = (rf"""(?<=[=:]\s{{0,3}}["']?)(?<={_ASSIGNED})(?:(?<=["'])[^"'\r\n]+(?=["'])|[^\s"'&<>]*[^\s"'&<>.,;)\]}}])"""
             r"""|(?<=:)(?<=://[^\s/:@"']{1,64}:)[^\s/:@"']+(?=@)"""
             rf"""|(?<!{_RUN})(?!{_RUN}*{_NAME}["']?\s{{0,3}}[=:]){_RUN}{{12,}}+={{0,2}}""")
CONTEXT = 48            # characters kept on either side
MAX_TRAIN, MAX_NEIGHBOURS = 8000, 200
WORD_SHARE = 1e-4       # of the documents hold a word of the dictionary; two at least
THRESHOLD = 0.5
MASK = "[SECRET]"
_NONE = -8.0            # letter-pair score of a candidate without letter pairs

FEATURES = ("length", "digits", "capitals", "variety", "class_changes", "letter_pairs", "coverage", "slashes", "in_path", "test_path",
            "neighbour", "assigned", "quoted", "in_address")


_EDGE = "\uffff"  # no character; a text that holds it all the same is cut by two evaluations of the expression


def _cut(t: Column) -> Column:
    """A text cut at its candidates: what stands before the first, the first, what follows it, the second, …"""
    cut = F.split(F.regexp_replace(t, CANDIDATE, f"{_EDGE}$0{_EDGE}"), _EDGE, -1)
    gaps, found = F.split(t, CANDIDATE, -1), F.regexp_extract_all(t, F.lit(CANDIDATE), 0)
    apart = F.flatten(F.zip_with(gaps, found, lambda g, v: F.filter(F.array(g, v), lambda x: x.isNotNull())))
    return F.when(t.contains(_EDGE), apart).otherwise(cut)


def candidates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = "source") -> DataFrame:
    """One row per candidate: ``id, text_key, place, start, value, before, after, path``.

    ``place`` numbers a text's candidates from 0, ``start`` is the offset in code points,
    ``text_key`` a digest of the text that tells apart rows with the same id.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    where = F.col(f"`{path}`").cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), t.alias("t"), where.alias("path"))
    at = F.when(F.size("parts") > 1, F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2)))
    zipped = F.transform(at, lambda i: F.struct(F.get("parts", i).alias("value"), F.right(F.get("parts", i - 1), F.lit(CONTEXT)).alias("before"),
                                                F.left(F.get("parts", i + 1), F.lit(CONTEXT)).alias("after"), F.length(F.get("parts", i - 1)).alias("gap")))
    one = (rows.select("id", "path", F.xxhash64("t").alias("text_key"), _cut(F.col("t")).alias("parts"))
           .select("id", "path", "text_key", F.posexplode_outer(zipped).alias("place", "c")).filter("c IS NOT NULL").select("id", "path", "text_key", "place", "c.*"))
    # Repeated rows have the same candidates, which count once.
    keys = ["id", "text_key", "path", "place"]
    one = one.groupBy(*keys).agg(F.min(F.struct("value", "before", "after", "gap")).alias("c")).select(*keys, "c.*")
    w = Window.partitionBy("id", "text_key", "path").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("value")
    return one.withColumn("start", F.sum(F.col("gap") + size).over(w) - size).drop("gap")


def labelled_by_format(rows: DataFrame) -> DataFrame:
    """Label candidates by unmistakable formats: the labelled findings of the production query.

    1: an access key id (``AKIA`` and 16 capitals or digits), the password of an address, or a value assigned to a name like
    password, token, secret or api key (after a colon, as in prose, only one with a digit or a
    sign, in quotes, or of 12 characters). 0: numbers, words, parts of addresses and paths, fill
    of one character. Null: any other format, which may be a key or not.
    """
    v, before = F.col("value"), F.col("before")
    key = v.rlike(r"^AKIA[0-9A-Z]{16}$")
    login = before.rlike(r"""://[^\s/:@"']{1,64}:$""") & F.col("after").startswith("@")
    assigned = before.rlike(_ASSIGNED + "$")
    sure = before.rlike(r"""[="']\s{0,3}$""") | v.rlike(r"[^A-Za-z]") | (F.length(v) >= 12)
    number = v.rlike(r"^[0-9+/_\-]+$")
    word = v.rlike(r"^[_\-/+]*(?:[A-Z]?[a-z]{1,24}|[A-Z]{1,11})(?:[_\-/+]+(?:[A-Z]?[a-z]{1,24}|[A-Z]{1,11}))*[_\-/+]*$")
    path = v.rlike(r"^/?[a-z_\-]+[0-9]*(?:/[a-z0-9_\-]+)+/?$") | before.rlike(r"(?:://|www\.)\S*$")
    address = before.rlike(r"@$") | F.col("after").rlike(r"^@")
    fill = v.rlike(r"(.)\1{15}")
    return rows.withColumn("label", F.when(key | login | (assigned & sure), 1.0).when(assigned, F.lit(None).cast("double"))
                           .when(number | word | path | address | fill, 0.0))


@dataclass
class Scanner:
    """Tables and forest of a fitted scanner; ``prior`` stands in where the labels hold one class."""

    dictionary: list[str] | DataFrame  # column ``word``
    pairs: list[float]
    neighbours: dict[str, float]
    forest: PipelineModel | None = None
    prior: float = 0.0

    def features(self, rows: DataFrame) -> DataFrame:
        v, low = F.col("value"), F.lower("value")
        n = F.greatest(F.length(v), F.lit(1))

        def share(pattern: str) -> Column:
            return F.size(F.regexp_extract_all(v, F.lit(pattern), 0)) / n

        table = F.array(*[F.lit(p) for p in self.pairs])
        letters = F.col("_letters")  # all letter pairs, in one pass over the candidate
        total = F.aggregate(letters, F.lit(0.0), lambda acc, p: acc + F.element_at(table, (F.ascii(p) - 97) * 26 + F.ascii(F.substring(p, 2, 1)) - 96))
        word = F.regexp_extract(F.lower("before"), r"([\p{L}_]+)[^\p{L}_]*$", 1)
        odds = F.coalesce(F.element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in self.neighbours]), F.array(*[F.lit(x) for x in self.neighbours.values()])), word), F.lit(0.0)) if self.neighbours else F.lit(0.0)
        if isinstance(self.dictionary, DataFrame):
            rows = rows.join(self.words_in(rows), "value", "left")
            bare = n - F.coalesce("_covered", F.lit(0))
        else:
            bare = F.length(F.regexp_replace(low, "|".join(sorted(self.dictionary, key=lambda w: (-len(w), w))), "")) if self.dictionary else n
        columns = {
            "length": n, "digits": share("[0-9]"), "capitals": share("[A-Z]"),
            "variety": F.size(F.array_distinct(F.split(v, ""))) / n,
            "class_changes": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])"),
            "letter_pairs": F.when(F.size(letters) > 0, total / F.size(letters)).otherwise(_NONE),
            "coverage": 1 - bare / n,
            "slashes": share("/"),
            "in_path": F.col("before").rlike(r"(://|[./\\])\S*$").cast("int"),
            "test_path": F.coalesce(F.col("path").rlike(r"(?i)(^|[/_.\-])(tests?|examples?|mocks?|fixtures?|docs?)([/_.\-]|$)"), F.lit(False)).cast("int"),
            "neighbour": odds,
            "assigned": F.col("before").rlike(r"""[=:]\s{0,3}["']?$""").cast("int"),
            "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("int"),
            "in_address": (F.col("before").rlike(r"[@.]$") | F.col("after").rlike(r"^(@|\.[A-Za-z0-9])")).cast("int"),
        }
        rows = rows.withColumn("_letters", F.regexp_extract_all(low, F.lit("(?=([a-z]{2}))"), 1))
        return rows.withColumns({f"f_{k}": c.cast("double") for k, c in columns.items()}).drop("_letters", "_covered")

    def words_in(self, rows: DataFrame) -> DataFrame:
        """``value, _covered``: letters of each value that belong to words of the dictionary."""
        parts = F.regexp_extract_all("value", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), 0)
        part = rows.select("value").distinct().select("value", F.explode_outer(parts).alias("word")).withColumn("word", F.lower("word"))
        return part.join(self.dictionary, "word", "left_semi").groupBy("value").agg(F.sum(F.length("word")).alias("_covered"))

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``score`` (share of trees for a secret) and ``is_secret``."""
        if self.forest is None:
            out = rows.withColumn("score", F.lit(self.prior))
        else:
            out = self.forest.transform(self.features(rows)).withColumn("score", F.round(vector_to_array("probability")[1], 9))
            out = out.select(*rows.columns, "score")
        return out.withColumn("is_secret", F.col("score") >= THRESHOLD)


def _share(n: int, most: int) -> Column:
    return F.lit(int(min(1.0, most / max(1, n)) * 1_000_000))


def train(docs: DataFrame, findings: DataFrame, text: str = "text", trees: int = 40, depth: int = 6, seed: int = 5) -> Scanner:
    """Fit on labelled ``findings`` (``candidates`` with a 0/1 ``label``; null labels are ignored)."""
    body = docs.select(F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("t"))
    words = materialise(body.select(F.explode_outer(F.array_distinct(F.regexp_extract_all("t", F.lit(r"\p{L}{2,}"), 0))).alias("word")).filter("word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    dictionary = words.filter(F.col("word").rlike("^[a-z]{3,}$") & (F.col("n") >= max(2.0, WORD_SHARE * body.count()))).select("word")
    pair = (words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("p"))
            .filter(F.col("p").rlike("^[a-z]{2}$")).groupBy("p").count())
    count = {r["p"]: r["count"] for r in pair.collect()}  # 676 pairs at most
    a_z = "abcdefghijklmnopqrstuvwxyz"
    rows = {a: sum(count.get(a + b, 0) for b in a_z) + 26 for a in a_z}
    pairs = [round(math.log((count.get(a + b, 0) + 1) / rows[a]), 6) for a in a_z for b in a_z]

    known = findings.filter("label IN (0, 1)").groupBy("value").agg(F.min(F.struct("before", "after", "path", "label")).alias("x")).select("value", "x.*")
    known = materialise(known.filter(F.pmod(F.xxhash64("value"), F.lit(1_000_000)) < _share(known.count(), MAX_TRAIN)), "known")
    near = known.groupBy(F.regexp_extract(F.lower("before"), r"([\p{L}_]+)[^\p{L}_]*$", 1).alias("word")).agg(F.sum("label").alias("yes"), F.count(F.lit(1)).alias("n"))
    top = near.filter("word <> ''").orderBy(F.col("n").desc(), "word").limit(MAX_NEIGHBOURS).collect()
    neighbours = {r["word"]: round(math.log((r["yes"] + 1) / (r["n"] - r["yes"] + 1)), 6) for r in top}
    n, yes = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    scanner = Scanner(dictionary, pairs, neighbours, prior=yes / n if n else 0.0)
    if 0 < yes < n:
        assembler = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features")
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2)
        # A bounded sample in one fixed order, so that every run grows the same trees.
        data = assembler.transform(scanner.features(known)).repartition(1).sortWithinPartitions("value").select("features", "label")
        scanner.forest = PipelineModel([assembler, forest.fit(data)])
    return scanner


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = "source", findings: DataFrame | None = None) -> DataFrame:
    """Every candidate with its verdict: ``id_col, text_key, place, start, value, score, is_secret``.

    ``findings``: labelled findings to learn from (default: this table's own, labelled by format).

    Defined results: null and empty texts have no candidate; a text without a verdict above
    ``THRESHOLD`` has findings but no secret; repeated rows (same id, text and path) share their
    findings, returned once; where the labels hold one class only, every candidate gets that class'
    share as score; further columns are ignored.
    """
    rows = materialise(candidates(docs, text, id_col, path), "candidates")
    scanner = train(docs, labelled_by_format(rows) if findings is None else findings, text)
    return scanner.score(rows).select(F.col("id").alias(id_col), "text_key", "place", "start", "value", "score", "is_secret")


def redact(docs: DataFrame, found: DataFrame, text: str = "text", id_col: str = "doc_id", mask: str = MASK) -> DataFrame:
    """``docs`` with every secret of ``found`` replaced by ``mask``; all rows and columns stay."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    hits = found.filter("is_secret").groupBy(F.col(id_col).alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("place").alias("_places"))
    rows = docs.withColumn("_k", F.xxhash64(t))
    joined = rows.join(hits, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
    # Candidate k is part 2 k + 1.
    rebuilt = F.array_join(F.transform(_cut(t), lambda v, i: F.when((i % 2 == 1) & F.array_contains("_places", (i / 2).cast("int")), F.lit(mask)).otherwise(v)), "")
    return joined.withColumn(text, F.when(F.col("_places").isNull(), F.col(f"`{text}`")).otherwise(rebuilt)).drop("_k", "_id", "_key", "_places")
