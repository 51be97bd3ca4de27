"""Sources, sinks and table shaping for document tables (section 2.1)."""

from __future__ import annotations

import json
import os
import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.common import key_hash
from vellum.operators.ranking import global_index

DEFAULT_SOURCE = "Unknown"


def read_documents(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    """CSV with a header (quoted multi-line fields) or any table format Spark reads.

    A quoted line break makes a CSV file unsplittable, so each file is one task; pass
    ``multi_line=False`` for large files without such fields. A missing path raises.
    """
    if fmt == "csv":
        return (spark.read.option("header", True).option("multiLine", multi_line)
                     .option("escape", '"').csv(path))
    return spark.read.format(fmt).load(path)


def load_config(path: str, name: str) -> dict:
    """One dataset entry of a nested JSON config (small driver-side dict)."""
    with open(path) as fh:
        cfg = json.load(fh)
    if name not in cfg:
        raise ValueError(f"the configuration has no entry named {name}")
    return cfg[name]


def normalise_documents(df: DataFrame, cfg: dict, id_col: str | None = "doc_id",
                        default_source: str = DEFAULT_SOURCE) -> DataFrame:
    """Map configured fields to ``doc_id, Text, Source, Time``.

    ``""`` or missing field names mean "absent": Time becomes ``''``, Source the default.
    A missing text column is an error.
    """
    cols = set(df.columns)
    text_field = cfg.get("text_field") or ""
    if not text_field or text_field not in cols:
        raise ValueError(f"the table has no text column {text_field!r}")
    src_field = cfg.get("source_field") or ""
    time_field = cfg.get("time_field") or ""
    src = F.col(src_field).cast("string") if src_field in cols else F.lit(cfg.get("source") or default_source)
    tm = F.col(time_field).cast("string") if time_field in cols else F.lit("")
    key = [F.col(id_col).cast("long").alias("doc_id")] if id_col and id_col in cols else []
    return df.select(*key, F.col(text_field).cast("string").alias("Text"), src.alias("Source"), tm.alias("Time"))


def union_sources(user: DataFrame | None, background: DataFrame | None) -> DataFrame | None:
    """User rows first, then background rows, keyed by ``(origin, doc_id)``."""
    parts = []
    if user is not None:
        parts.append(user.withColumn("origin", F.lit(0)))
    if background is not None:
        parts.append(background.withColumn("origin", F.lit(1)))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sample_documents(df: DataFrame, n: int | None, shuffle: bool = True, seed: int = 42,
                     id_col: str = "doc_id") -> DataFrame:
    """``0 < n < total``: the first n rows in hash order when shuffling, else in key order.

    A seeded md5 of the key gives a deterministic order (a task re-run after an executor
    loss draws the same rows). The keys are ranked by a range-partitioned global index
    and the rows semi-joined, so no task gathers the sample. No n → all rows.
    """
    order = ([F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))] if shuffle else []) + [F.col(id_col)]
    if n is None or n <= 0:
        return df
    keys = df.select(id_col, *[o.alias(f"_o{i}") for i, o in enumerate(order[:-1])])
    ranked = global_index(keys, [F.col(f"_o{i}") for i in range(len(order) - 1)] + [F.col(id_col)], "_rank")
    return df.join(ranked.filter(F.col("_rank") < int(n)).select(id_col), id_col, "left_semi")


def split_documents(df: DataFrame, train_share: int = 80, id_col: str = "doc_id", split_col: str = "split",
                    weights: dict[str, float] | None = None, seed: int | None = None) -> DataFrame:
    """Named splits by a key hash bucket in [0, 100): deterministic, no shuffle.

    ``train``/``test`` by ``train_share``, or any names by ``weights`` (relative shares, in
    order). A ``seed`` draws another split of the same shares.
    """
    key = F.col(id_col) if seed is None else F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))
    bucket = key_hash(key) % 100
    shares = weights or {"train": train_share, "test": 100 - train_share}
    edges = list(accumulate(shares.values()))
    name = F.lit(list(shares)[-1])
    for split, edge in reversed(list(zip(shares, edges, strict=True))[:-1]):
        name = F.when(bucket < F.lit(100.0 * edge / edges[-1]), F.lit(split)).otherwise(name)
    return df.withColumn(split_col, name)


def select_split(df: DataFrame, name: str = "train", split_col: str = "split", train_share: int = 80,
                 id_col: str = "doc_id") -> DataFrame:
    """Rows of a named split; tables without a split column get one by key hash first."""
    if split_col not in df.columns:
        df = split_documents(df, train_share, id_col, split_col)
    return df.filter(F.col(split_col) == name)


def attach_results(df: DataFrame, results: DataFrame, on: str = "doc_id") -> DataFrame:
    """Left equi-join of result columns; same-named columns are replaced by the results."""
    clash = [c for c in results.columns if c in df.columns and c != on]
    return df.drop(*clash).join(results, on, "left")


def attach_truncated(df: DataFrame, results: DataFrame, id_col: str = "doc_id",
                     res_order: str | None = None) -> DataFrame:
    """Positional attach of a result table of another length: the i-th document (key
    order) gets the i-th result row; the longer side is cut to the shorter.

    Positions come from :func:`global_index` (range-partitioned, no single-task window)
    and the pairing is an equi-join on the position.
    """
    res_order = res_order or id_col
    r = results
    if res_order in df.columns:
        r = r.withColumnRenamed(res_order, "result_" + res_order)
        res_order = "result_" + res_order
    # Only the keys are ranked (and checkpointed); the rows join back on their keys.
    lpos = global_index(df.select(id_col), [F.col(id_col)], "_pos")
    rpos = global_index(r.select(res_order), [F.col(res_order)], "_pos")
    pairs = lpos.join(rpos, "_pos").drop("_pos")
    return df.join(pairs, id_col).join(r, res_order)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint folder (shared on a cluster)."""
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        from vellum.session import ensure_checkpoint_dir
        base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "vellum-tables", f"{name}-{uuid.uuid4().hex}")


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Replace the result table at ``path``, which ``df`` may itself read.

    The rows are written to a sibling folder first; only when that has succeeded does it
    take the place of the old table, which is removed last. A failed write leaves the
    old table as it was.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    token = uuid.uuid4().hex
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh, old = (jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{kind}-{token}") for kind in ("new", "old"))
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(fresh.toString())
    else:
        w.format(fmt).save(fresh.toString())
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"cannot move {path} aside; the new rows are in {fresh.toString()}")
    if not fs.rename(fresh, target):
        fs.rename(old, target)
        raise OSError(f"cannot move the new rows to {path}")
    if fs.exists(old):
        fs.delete(old, True)
    spark.catalog.refreshByPath(path)
    return path


def save_variance(variance: DataFrame, base_path: str, version: str) -> str:
    """Persist a parameter-variance table under ``version=…`` (one partition per version)."""
    (variance.withColumn("version", F.lit(version)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(base_path))
    return base_path


def load_variance(spark: SparkSession, base_path: str, version: str) -> DataFrame | None:
    """Reload one version (partition pruning reads only that folder).

    None if the store or the version is missing; any other failure is raised.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    df = spark.read.parquet(base_path).filter(F.col("version") == version).drop("version")
    return None if df.isEmpty() else df
