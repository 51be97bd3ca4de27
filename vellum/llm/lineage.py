"""Written intermediate tables and connected components shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import ensure_checkpoint_dir


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation beyond this table, and several
    readers share one evaluation. The folder is the cluster's ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, name: str = "components", max_rounds: int = 100) -> DataFrame:
    """``node, root``: the smallest node of each connected component, for every node of an edge.

    ``edges`` has long columns ``a, b``. Alternates large-star and small-star steps until the
    edges no longer change: each step is one minimum per node (combined before the shuffle)
    and one join back. A graph that has not settled after ``max_rounds`` raises.
    """
    star = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = _mark(star)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        # Large star: every larger neighbour of a node moves to the smallest node around it.
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low")
        larger = star.select(F.col("b").alias("a"), F.col("a").alias("v"))
        large = larger.join(low, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        large = materialise(large, f"{name}-large")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        new = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        seen = _mark(new)
        star = new
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    """Count and order-free checksums of an edge table."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.shiftright(h, 16)), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first()
    return int(row[0]), int(row[1]), int(row[2])
