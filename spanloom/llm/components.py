"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b"), F.col("m").alias("a")).select("a", "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. Here a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    linked = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return linked.unionByName(least.select(F.col("m").alias("a"), "b")).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node of the component) of every node of ``edges`` (a, b).

    Edges with a NULL end and loops are ignored; repeats and direction do not matter. Nodes are
    compared as they are, so strings in plain order. Each round is written to the shared folder and the
    last round's files are deleted; the loop ends when a round changes nothing, after about the
    logarithm of the longest path. Only counts and hash sums come to the driver.

    A node of very many neighbours is no single task: its neighbours are pre-aggregated to a minimum
    before the shuffle, and the join against that one row is split by AQE.
    """
    now = materialise(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        new = materialise(_small_star(_large_star(now)), "edges")
        discard(now)
        now = new
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"not converged in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
