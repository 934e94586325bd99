"""Segments and keyframes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, group: str, start: str = "a", end: str = "b") -> DataFrame:
    """Segments of a group that overlap or touch (by 1) as one. Ends in either order; NULL ends are left out.

    Of the segments with one start only the longest is sent on, before the shuffle, so a group of very many rows comes to
    no more than its frames.
    """
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(group, F.least(start, end).alias("a"), F.greatest(start, end).alias("b"))
    rows = rows.groupBy(group, "a").agg(F.max("b").alias("b"))
    w = Window.partitionBy(group).orderBy("a")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.col("a") > reach + 1), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(group, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")


def densified(keyframes: DataFrame, group: str, first: int, last: int, frame: str = "frame", value: str = "x") -> DataFrame:
    """A value for each frame from ``first`` to ``last``: between keyframes linear, to the nearest even; constant outside.

    Each keyframe makes the frames up to the next, so nothing is joined. ``frame`` is unique within its group.
    """
    w = Window.partitionBy(group).orderBy(frame)
    k = keyframes.select(group, F.col(frame).alias("f0"), F.col(value).cast("double").alias("v0"), F.lead(frame).over(w).alias("f1"), F.lead(value).over(w).cast("double").alias("v1"), F.row_number().over(w).alias("_n"))
    lo = F.when(F.col("_n") == 1, F.lit(first)).otherwise(F.greatest(F.lit(first).cast("long"), F.col("f0")))
    hi = F.when(F.col("f1").isNull(), F.lit(last)).otherwise(F.least(F.lit(last).cast("long"), F.col("f1") - 1))
    made = k.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("frame", F.explode(F.sequence("lo", "hi")))
    t = (F.col("frame") - F.col("f0")) / (F.col("f1") - F.col("f0"))
    inside = F.rint(F.col("v0") + (F.col("v1") - F.col("v0")) * t)
    return made.select(group, "frame", F.when(F.col("f1").isNull() | (F.col("frame") <= F.col("f0")), F.col("v0")).otherwise(inside).alias(value))


def keyframe_grid(df: DataFrame, start: str, end: str, stride: int) -> DataFrame:
    """Adds ``frames``: every ``stride``-th from start, and the end."""
    grid = F.array_union(F.sequence(start, end, F.lit(max(1, stride)).cast("long")), F.array(end))
    return df.withColumn("frames", F.when(F.col(start) <= F.col(end), grid))
