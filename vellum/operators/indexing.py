"""Document embeddings by random indexing.

Every term has a sparse index vector drawn from a hash of the term: a few places with +1 or -1.
A term's context vector is the sum of the index vectors of its neighbours within ``window``
words, over the whole corpus: whole numbers, added up inside each batch and then per term, so
the result does not depend on the order of the rows. A document is the weighted sum of its terms'
unit context vectors. Angles between context vectors approach those between the rows of the full
co-occurrence table as the dimension grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import packed as P
from vellum.operators import rows as R
from vellum.operators import term_blocks as B

PLACES = 4  # entries of an index vector that are not 0


def index_vectors(terms: list[str], dim: int, seed: int) -> np.ndarray:
    """The index vectors of some terms: ``PLACES`` seeded draws of a place and a sign."""
    import hashlib
    out = np.zeros((len(terms), dim), np.int64)
    for i, t in enumerate(terms):
        draw = np.frombuffer(hashlib.md5(f"{seed}:{t}".encode()).digest(), np.uint32)[:PLACES]
        np.add.at(out[i], draw % dim, np.where(draw >> np.uint32(31), 1, -1))
    return out


def context_vectors(df: DataFrame, tokens_col: str = "tokens", dim: int = 32, window: int = 2, seed: int = 42) -> DataFrame:
    """``term, vector``: per term the summed index vectors of its neighbours (array of longs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            coded = column.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            terms = coded.dictionary
            if not len(terms):
                continue
            doc = np.repeat(np.arange(len(size)), size)
            index, total = index_vectors(terms.to_pylist(), dim, seed), np.zeros((len(terms), dim), np.int64)
            for gap in range(1, window + 1):
                near = np.flatnonzero(doc[gap:] == doc[:-gap])
                a, b = code[near], code[near + gap]
                # Each ordered pair of terms once, with its number of times.
                pair, times = np.unique(a.astype(np.int64) * len(terms) + b, return_counts=True)
                a, b = pair // len(terms), pair % len(terms)
                for x, y in ((a, b), (b, a)):
                    order = np.argsort(x, kind="stable")
                    mine, first = np.unique(x[order], return_index=True)
                    if len(mine):
                        total[mine] += np.add.reduceat(index[y[order]] * times[order][:, None], first, axis=0)
            yield pa.RecordBatch.from_arrays([terms, pa.ListArray.from_arrays(pa.array(np.arange(len(terms) + 1) * dim, pa.int32()), pa.array(total.ravel()))], names=["term", "vector"])

    clean = df.select(F.filter(tokens_col, lambda t: t.isNotNull()).alias("t"))
    parts = clean.mapInArrow(run, "term string, vector array<long>")
    return parts.groupBy("term").agg(F.array(*[F.sum(F.col("vector")[j]) for j in range(dim)]).alias("vector"))


def embed(df: DataFrame, tokens_col: str = "tokens", dim: int = 32, window: int = 2, seed: int = 42, id_col: str = "doc_id", out_col: str = "embedding") -> DataFrame:
    """``df`` with one vector per document: its terms' unit context vectors, weighted by count x idf, at unit length.

    Defined results: a document without a term, or whose terms have no neighbours anywhere, gets
    zeros; rows that repeat an id share the vector of all their tokens together; an empty table
    gives an empty one.
    """
    # The tokens are made once: counts, documents and neighbourhoods are read from the written table.
    held, _ = R.store(df.select(F.col(id_col), F.col(tokens_col).alias("tokens"), P.counted(F.col(tokens_col)).alias("c")), "tokens")
    blocks = B.write_packed(held.select(id_col, "c.term", "c.n"), id_col)
    idf = F.log((F.lit(1.0) + blocks.n_docs) / (F.lit(1.0) + F.sum("docs"))) + 1
    weight = blocks.needs.groupBy("term").agg(idf.alias("idf"))
    terms, _ = R.store(context_vectors(held, "tokens", dim, window, seed).join(weight, "term"), "contexts")

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        doc, term, n, ids, order = B.codes(block, answers)
        v = B.vectors(answers["vector"], order, dim).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
        w = n * answers["idf"].to_numpy()[order][term]
        out = np.stack([np.bincount(doc, weights=w * v[term, j], minlength=len(ids)) for j in range(dim)], axis=1)
        out /= np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None]
        return pa.table({"doc": ids, "vector": pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * dim, pa.int32()), pa.array(out.ravel()))})

    kind = dict(blocks.counts.dtypes)["doc"]
    found = blocks.meet(terms, run, f"doc {kind}, vector array<double>").select(F.col("doc").alias(id_col), F.col("vector").alias(out_col))
    return df.join(found, id_col, "left").withColumn(out_col, F.coalesce(out_col, F.array_repeat(F.lit(0.0), dim)))
