"""Features in one row per document: ``term``, ``n`` and ``x`` are arrays of equal length.

A document's terms stay in its row from the tokeniser to its scores, so joins, windows and
shuffles move one row per document instead of one per term. Arrow batches count a row's terms,
keep those of a vocabulary, and add up weighted sums against a model-sized table. A table beyond
``common.BROADCAST_ROWS`` is not sent to the tasks: the caller unpacks the features and joins.
Terms stand in byte order inside a row, so sums do not depend on the batch.

``term`` may also hold integers: the places of the terms in a sorted vocabulary (:func:`placed`), which
take a fraction of the room of their names and need no search for their weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.common import BROADCAST_ROWS

COUNTED = "struct<term:array<string>,n:array<bigint>>"
WORDS = "struct<words:string,n:array<int>>"
PLACED = "struct<term:array<int>,n:array<int>>"
# Rows of a table keyed by a term's place that a task may hold (32 bytes each for four classes).
PLACED_ROWS = 4_000_000


def is_packed(features: DataFrame, term_col: str = "term") -> bool:
    return dict(features.dtypes)[term_col].startswith("array")


def small_table(df: DataFrame, max_rows: int | None = None) -> pa.Table | None:
    """The rows of a model-sized table, or None if it has more than the broadcast limit."""
    limit = (PLACED_ROWS if dict(df.dtypes).get("term") == "int" else BROADCAST_ROWS) if max_rows is None else max_rows
    rows = df.limit(limit + 1).toArrow()
    return rows if rows.num_rows <= limit else None


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(lengths, row of each element, elements) of a list column; a null list has none."""
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    return size, np.repeat(np.arange(len(size)), size), column.flatten()


def _offsets(size: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(size)), pa.int32())


def counted(tokens: str | Column, vocab: pa.Array | None = None) -> Column:
    """A token array's distinct terms (of ``vocab``, if given) in byte order with their counts."""
    known = None if vocab is None else vocab.take(pc.sort_indices(vocab))

    @F.arrow_udf(COUNTED)
    def count(tokens: pa.Array) -> pa.Array:
        size, row, flat = _flat(tokens)
        if known is None:
            coded = flat.dictionary_encode()
            order = np.asarray(pc.sort_indices(coded.dictionary))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row, code = row[code >= 0], code[code >= 0]
            code, terms = place[code], coded.dictionary.take(pa.array(order))
        else:
            code = pc.index_in(flat, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row, code, terms = row[code >= 0], code[code >= 0], known
        width = max(1, len(terms))
        key, n = np.unique(row * width + code, return_counts=True)
        off = _offsets(np.bincount(key // width, minlength=len(size)))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(off, terms.take(pa.array(key % width))),
                                           pa.ListArray.from_arrays(off, pa.array(n.astype(np.int64)))], names=["term", "n"])

    return count(tokens)


def candidates(rows: DataFrame, terms: str, share: float) -> DataFrame:
    """``term``: those in at least ``share`` of the rows of some batch of ``rows``, an array of terms each.

    A term in that share of all rows is one of them, whatever the batches. The many rare terms never leave theirs.
    """
    def run(batches):
        for batch in batches:
            size, row, flat = _flat(batch.column(0))
            coded = flat.dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row, code = row[code >= 0], code[code >= 0]
            width = max(1, len(coded.dictionary))
            # Terms that occur too rarely altogether are left out before rows are told apart.
            least = share * len(size) * (1 - 1e-9)
            often = np.bincount(code, minlength=width) >= least
            row, code = row[often[code]], code[often[code]]
            df = np.bincount(np.unique(row * width + code) % width, minlength=width)
            found = np.flatnonzero((df >= least) & (df > 0))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(found))], names=["term"])

    return rows.select(terms).mapInArrow(run, "term string").distinct()


def counted_places(tokens: str | Column, vocab: pa.Array) -> Column:
    """A token array's distinct terms of the sorted ``vocab``, as their places, with their counts."""
    @F.arrow_udf(PLACED)
    def count(tokens: pa.Array) -> pa.Array:
        size, row, flat = _flat(tokens)
        code = pc.index_in(flat, value_set=vocab).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row, code, width = row[code >= 0], code[code >= 0], max(1, len(vocab))
        key, n = np.unique(row * width + code, return_counts=True)
        off = _offsets(np.bincount(key // width, minlength=len(size)))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(off, pa.array((key % width).astype(np.int32))),
                                           pa.ListArray.from_arrays(off, pa.array(n.astype(np.int32)))], names=["term", "n"])

    return count(tokens)


def place_frequencies(rows: DataFrame, places: int) -> DataFrame:
    """``term, df, cf`` of packed counts whose terms are places below ``places``: summed within a task, then over tasks."""
    def run(batches):
        df, cf = np.zeros(places, np.int64), np.zeros(places)
        for batch in batches:
            code = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            df += np.bincount(code, minlength=places)
            cf += np.bincount(code, weights=batch.column(1).flatten().to_numpy(zero_copy_only=False), minlength=places)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held]), pa.array(cf[held].astype(np.int64))], names=["term", "df", "cf"])

    each = rows.select("term", "n").mapInArrow(run, "term int, df long, cf long")
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def weighted(idf: np.ndarray, term: str = "term", n: str = "n") -> Column:
    """The kept places of a packed row (those with a number in ``idf``) with count, idf and their product."""
    @F.arrow_udf("struct<term:array<int>,tf:array<bigint>,idf:array<double>,raw:array<double>>")
    def weigh(term: pa.Array, n: pa.Array) -> pa.Array:
        size, row, flat = _flat(term)
        at, count = flat.to_numpy(zero_copy_only=False), n.flatten().to_numpy(zero_copy_only=False)
        held = ~np.isnan(idf[at])
        at, count, off = at[held], count[held].astype(np.int64), _offsets(np.bincount(row[held], minlength=len(size)))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(off, pa.array(v)) for v in (at.astype(np.int32), count, idf[at], count * idf[at])],
                                          names=["term", "tf", "idf", "raw"])

    return weigh(term, n)


def kept(term: str, n: str, vocab: pa.Array) -> Column:
    """The terms of a packed row that stand in ``vocab``, with their counts."""
    @F.arrow_udf(COUNTED)
    def keep(term: pa.Array, n: pa.Array) -> pa.Array:
        size, row, flat = _flat(term)
        held = pc.is_in(flat, value_set=vocab)
        off = _offsets(np.bincount(row[held.to_numpy(zero_copy_only=False)], minlength=len(size)))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(off, flat.filter(held)),
                                           pa.ListArray.from_arrays(off, n.flatten().filter(held))], names=["term", "n"])

    return keep(term, n)


def _cut(words: pa.Array) -> pa.Array:
    """The words of each space-joined string (none in an empty one)."""
    return pc.split_pattern(pc.if_else(pc.equal(words, ""), pa.scalar(None, pa.string()), words), " ")


def counted_words(text: Column, pattern: str, leave_out: list[str]) -> Column:
    """A text's distinct words, in byte order and joined by a space, with their counts.

    Words stand between single spaces, match ``pattern`` and are not in ``leave_out``; both are tested once
    for each distinct word of a batch. A row is one string and one array of numbers on its way.
    """
    out = pa.array(leave_out, pa.string())

    @F.arrow_udf(WORDS)
    def count(text: pa.Array) -> pa.Array:
        size, row, flat = _flat(pc.split_pattern(text, " "))
        coded = flat.dictionary_encode()
        found = coded.dictionary
        held = np.flatnonzero(np.asarray(pc.and_(pc.match_substring_regex(found, pattern), pc.invert(pc.is_in(found, value_set=out)))))
        terms = found.take(pa.array(held))
        order = np.asarray(pc.sort_indices(terms)).astype(np.int64)
        place = np.full(len(found), -1)
        place[held[order]] = np.arange(len(order))
        code = place[coded.indices.to_numpy(zero_copy_only=False)]
        row, code = row[code >= 0], code[code >= 0]
        width = max(1, len(order))
        key, n = np.unique(row * width + code, return_counts=True)
        off = _offsets(np.bincount(key // width, minlength=len(size)))
        words = pa.ListArray.from_arrays(off, terms.take(pa.array(order[key % width])))
        return pa.StructArray.from_arrays([pc.binary_join(words, " "), pa.ListArray.from_arrays(off, pa.array(n.astype(np.int32)))], names=["words", "n"])

    return count(text)


def word_frequencies(rows: DataFrame) -> DataFrame:
    """``term, df, cf`` of rows of :func:`counted_words`: counted within each batch, then summed."""
    def run(batches):
        for batch in batches:
            coded = _cut(batch.column(0)).flatten().dictionary_encode()
            code, n = coded.indices.to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            df = np.bincount(code, minlength=len(coded.dictionary)).astype(np.int64)
            cf = np.bincount(code, weights=n, minlength=len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df), pa.array(cf)], names=["term", "df", "cf"])

    each = rows.select("words", "n").mapInArrow(run, "term string, df long, cf long")
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def unpack_words(rows: DataFrame) -> DataFrame:
    """One row per word of rows of :func:`counted_words`, as ``term`` and ``n``."""
    words = F.when(F.length("words") > 0, F.split("words", " "))
    return unpack(rows.withColumn("term", words).withColumn("n", F.transform("n", lambda v: v.cast("long"))).drop("words"), ("term", "n"))


def placed(words: str, n: str, vocab: pa.Array) -> Column:
    """The places in the sorted ``vocab`` of a row's words (:func:`counted_words`) that stand in it, with their counts."""
    @F.arrow_udf(PLACED)
    def place(words: pa.Array, n: pa.Array) -> pa.Array:
        size, row, flat = _flat(_cut(words))
        at = pc.index_in(flat, value_set=vocab)
        held = at.is_valid()
        off = _offsets(np.bincount(row[held.to_numpy(zero_copy_only=False)], minlength=len(size)))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(off, at.filter(held)),
                                           pa.ListArray.from_arrays(off, n.flatten().filter(held))], names=["term", "n"])

    return place(words, n)


def place_of(term: str, vocab: pa.Array) -> Column:
    """The place of a term in the sorted ``vocab``."""
    @F.arrow_udf("int")
    def place(term: pa.Array) -> pa.Array:
        return pc.index_in(term, value_set=vocab)

    return place(term)


def named(term: str, vocab: pa.Array) -> Column:
    """The names of an array of places."""
    @F.arrow_udf("array<string>")
    def name(term: pa.Array) -> pa.Array:
        size, _, flat = _flat(term)
        return pa.ListArray.from_arrays(_offsets(size), vocab.take(flat))

    return name(term)


def with_totals(rows: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Packed counts with ``total``, their sum over the rows of one key."""
    total = F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, v: a + v)).over(Window.partitionBy(*keys))
    return rows.withColumn("total", total)


def with_shares(rows: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Packed counts with ``x``, the share of each count in its key's total (rows of one key together)."""
    return shares(with_totals(rows, keys))


def shares(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", F.transform("n", lambda v: v / F.col("total"))).drop("total")


def unpack(rows: DataFrame, columns=("term", "x")) -> DataFrame:
    """One row per term of a packed table."""
    keep = [c for c in rows.columns if c not in columns]
    return rows.select(*keep, F.inline(F.arrays_zip(*columns)))


def numbers(table: pa.Table, column: str, fill: float = 0.0) -> np.ndarray:
    return pc.fill_null(table[column].combine_chunks().cast(pa.float64()), fill).to_numpy(zero_copy_only=False)


def terms_of(table: pa.Table, term_col: str = "term") -> pa.Array:
    column = table[term_col]
    return column.combine_chunks() if column.num_chunks else pa.array([], column.type)


def _at(flat: pa.Array, terms: pa.Array) -> np.ndarray:
    """Place of each term in a table's rows, or -1."""
    if not pa.types.is_integer(terms.type):
        return pc.index_in(flat, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
    rows, flat = terms.to_numpy(), flat.to_numpy(zero_copy_only=False)
    place = np.full(max(rows.max(initial=-1), flat.max(initial=-1)) + 1, -1)
    place[rows] = np.arange(len(rows))
    return place[flat]


def sums(table: pa.Table, parts: list[tuple[str, int]], term_col: str = "term", x_col: str = "x") -> Column:
    """Per row the sum of ``x ** power * table[column]`` over its terms, for each ``(column, power)``."""
    terms, weights = terms_of(table, term_col), [(numbers(table, c), power) for c, power in parts]

    @F.arrow_udf("array<double>")
    def add(term: pa.Array, x: pa.Array) -> pa.Array:
        size, row, flat = _flat(term)
        at = _at(flat, terms)
        ok = at >= 0
        row, at, v = row[ok], at[ok], x.flatten().to_numpy(zero_copy_only=False)[ok]
        out = np.stack([np.bincount(row, weights=v ** power * w[at], minlength=len(size)) for w, power in weights], axis=1)
        return pa.ListArray.from_arrays(_offsets(np.full(len(size), len(weights))), pa.array(out.ravel()))

    return add(term_col, x_col)


def masked_sums(table: pa.Table, columns: list[str], mask: Column, passes: int, term_col: str = "term", x_col: str = "x") -> Column:
    """Per row, pass and column the sum of ``x * table[column]`` over the terms whose mask holds the pass's bit."""
    terms, weights = terms_of(table, term_col), [numbers(table, c) for c in columns]

    @F.arrow_udf("array<double>")
    def add(term: pa.Array, x: pa.Array, mask: pa.Array) -> pa.Array:
        size, row, flat = _flat(term)
        at = _at(flat, terms)
        ok = at >= 0
        row, at, v, bits = row[ok], at[ok], x.flatten().to_numpy(zero_copy_only=False)[ok], mask.flatten().to_numpy(zero_copy_only=False)[ok]
        value = [v * w[at] for w in weights]
        out = np.empty((len(size), passes * len(weights)))
        for i in range(passes):
            on = (bits >> i) & 1
            for k, y in enumerate(value):
                out[:, i * len(weights) + k] = np.bincount(row, weights=y * on, minlength=len(size))
        return pa.ListArray.from_arrays(_offsets(np.full(len(size), out.shape[1])), pa.array(out.ravel()))

    return add(F.col(term_col), F.col(x_col), mask)


def placed_sums(table: pa.Table, n_classes: int, places: int, term_col: str = "term", x_col: str = "x") -> Column:
    """Per row, place and class the sum of ``x * w_k`` over the terms whose place ``j_k`` it is (a null place: none)."""
    terms = terms_of(table, term_col)
    weights = [(numbers(table, f"w_{k}"), numbers(table, f"j_{k}", -1.0).astype(np.int64)) for k in range(n_classes)]

    @F.arrow_udf("array<double>")
    def add(term: pa.Array, x: pa.Array) -> pa.Array:
        size, row, flat = _flat(term)
        at = _at(flat, terms)
        ok = at >= 0
        row, at, v = row[ok], at[ok], x.flatten().to_numpy(zero_copy_only=False)[ok]
        out = np.zeros((len(size), places, n_classes))
        for k, (w, j) in enumerate(weights):
            here = j[at] >= 0
            cell = row[here] * places + j[at][here]
            out[:, :, k] = np.bincount(cell, weights=(v * w[at])[here], minlength=len(size) * places).reshape(len(size), places)
        return pa.ListArray.from_arrays(_offsets(np.full(len(size), places * n_classes)), pa.array(out.ravel()))

    return add(term_col, x_col)


def gradients(rows: DataFrame, n_classes: int) -> DataFrame:
    """``batch, term, g_0 … g_{K-1}`` (arrays): a batch's sums of ``r * x`` per term and class, divided by ``bs``."""
    def run(group: pa.Table) -> pa.Table:
        size, row, flat = _flat(group["term"].combine_chunks())
        coded = flat.dictionary_encode()
        code, v = coded.indices.to_numpy(zero_copy_only=False), group["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        r = group["r"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_classes)
        ends, bs = pa.array([0, len(coded.dictionary)], pa.int32()), group["bs"][0].as_py()
        sums = [np.bincount(code, weights=v * r[row, k], minlength=len(coded.dictionary)) / bs for k in range(n_classes)]
        return pa.table({"batch": group["batch"][:1], "term": pa.ListArray.from_arrays(ends, coded.dictionary)}
                        | {f"g_{k}": pa.ListArray.from_arrays(ends, pa.array(g)) for k, g in enumerate(sums)})

    each = ", ".join(f"g_{k} array<double>" for k in range(n_classes))
    return rows.select("batch", "bs", "r", "term", "x").groupBy("batch").applyInArrow(run, f"batch long, term {dict(rows.dtypes)['term']}, {each}")
