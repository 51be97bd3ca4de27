"""Small tables with every odd case, shared by the operator tests."""

import random

import pytest
from pyspark.sql import functions as F

# Names that the operators use inside, as extra columns of the input.
CLASHING = ["id", "t", "r", "row", "spans", "kept", "uid", "score", "n_words", "label", "value", "h", "block", "a.b", "odd name"]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.05 else ''}" for _ in range(n))


def twins(size=2048):
    """Two different words of a and b in Thue-Morse order: polynomial hashes modulo 2**64 cannot tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="session")
def odd_texts():
    """(doc_id, text) pairs: null, empty, blank, short, very long, repeated, near and shared passages."""
    rng = random.Random(4)
    base = words(rng, 120)
    near = base.split()
    passage = words(rng, 70)
    long = words(rng, 30_000, 20_000)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, base), (5, base), (6, "A" * 300), (7, "ab" * 400),
            (8, long), (9, long + " tail"), (10, passage + " " + words(rng, 80)), (11, words(rng, 60) + " " + passage), (12, "one two"),
            (13, "x" * 20_000), (14, "é" * 150 + passage), (15, "日本語のテキスト 😀 <|endoftext|> it's we'll"), (16, "12345 !!! ..."), (17, base + "\n" + base),
            (18, "line a b\nline a b\n\nline a b\r\nother"), (19, "café au lait " * 30)]
    one, two = twins()
    five = words(rng, 4)
    rows += [(20, f".{one}.{two}"), (21, f"{one}\n{two}\n{one} x y\n{two} x y"), (22, f"{one} {five}"), (23, f"{two} {five}")]
    for k in range(40):
        copy = list(near)
        copy[(7 * k) % len(copy)] = f"edit{k}"
        rows.append((100 + k, " ".join(copy)))
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", len(t or "")) for i, t in odd_texts]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit(f"extra {c}"))
    return df


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    from vellum.llm.queries import tokenizer_path
    return tokenizer_path()
