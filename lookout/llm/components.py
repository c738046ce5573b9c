"""Connected components by alternating large-star and small-star steps, in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("_m"))
    return both.join(least, F.col("a") == F.col("_a")).where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), "_m")
    hung = down.join(least, F.col("a") == F.col("_a")).where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return hung.unionByName(least.select(F.col("_a").alias("a"), F.col("_m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, group_id (the group's least node) of every node with an edge to another one. edges: a, b (long).

    Nulls and loops are no edges. Every round is written to the shared folder, which cuts the lineage; the frames of edges
    never reach the driver.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges")
    for _ in range(max_rounds):
        after = materialize(_small_star(_large_star(now)), "edges")
        if _checksum(after) == _checksum(now):
            hubs = after.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("group_id"))
            return after.select(F.col("a").alias("node"), F.col("b").alias("group_id")).unionByName(hubs)
        now = after
    raise RuntimeError(f"components aren't settled after {max_rounds} rounds")


def _checksum(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first())
