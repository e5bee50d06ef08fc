"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import Scratch, salted_join


def _print(edges: DataFrame):
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(h, F.lit((1 << 31) - 1))).alias("s"), F.bit_xor(h).alias("x")).first()
    return row["n"], row["s"], row["x"]


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (longs a, b); the root is the component's smallest node.

    Each round joins edges with per-node minima (partially aggregated before the shuffle). These joins are salted by the other
    end, so the edges of a hub are spread over several tasks; each round writes its edges to the shared folder. Rounds grow
    with the logarithm of the size. No edges give no rows; repeated edges and loops count once or not at all; edges with a
    null end are none.

    The joins are dealt by key, never broadcast, and a round is one plan: a broadcast would pass through the driver, and adaptive
    execution plans each stage of each round anew there. Both would add up in its memory over the rounds."""
    spark = edges.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return _components(edges, scratch, most)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _components(edges: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    now = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    seen = None
    for k in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both, least.hint("merge"), "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, low.hint("merge"), "a", "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch.write(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"edges{k}")
        if k:
            scratch.drop(len(scratch.paths) - 2)
        is_now = _print(now)
        if is_now == seen:
            break
        seen = is_now
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
