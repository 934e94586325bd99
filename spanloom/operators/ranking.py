"""Ranks and positions over any number of rows, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

#: Rows that one bucket of a ranked group is meant to hold.
BUCKET_ROWS = 4096


def positions(df: DataFrame, *by, name: str = "pos") -> DataFrame:
    """Adds the place of each row, from 0, in the order of ``by``; ``by`` should tell rows apart.

    Rows are range-partitioned and the parts written once, so that the counts per part, which give the offsets, and the
    rows that are numbered are the same even if a task is run again.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return (
        cut.withColumn("_within", within).join(F.broadcast(offsets.select("_part", "_before")), "_part")
        .withColumn(name, F.col("_before") + F.col("_within") - 1).drop("_part", "_within", "_before")
    )


def running(df: DataFrame, value: str, *by, name: str = "running") -> DataFrame:
    """Adds ``pos`` as :func:`positions` does, and ``name``: the sum of ``value`` up to and with the row, NULLs as 0."""
    placed = materialise(positions(df, *by), "running")
    parts = F.floor(F.col("pos") / BUCKET_ROWS)
    sums = placed.groupBy(parts.alias("_part")).agg(F.sum(F.coalesce(value, F.lit(0))).alias("_s"))
    # one row per BUCKET_ROWS rows
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    within = Window.partitionBy("_part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.withColumn("_part", parts).withColumn("_own", F.sum(F.coalesce(value, F.lit(0))).over(within)).join(before, "_part")
        .withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")
    )


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone, so that a lost task yields it again."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(2**53))


def ranked(df: DataFrame, group: list[str], size: str, key: str, tie: str, rank: str = "rank") -> DataFrame:
    """Adds ``rank`` (from 1, in the order of ``key`` then ``tie``) within ``group``.

    ``key`` lies in [0, 1), spread evenly; ``size`` is the number of rows of the group. The group is
    cut into buckets of about ``BUCKET_ROWS`` rows by the key, each bucket is ranked alone, and the
    bucket counts, one row per bucket, give the offsets.
    """
    buckets = F.greatest(F.lit(1.0), F.ceil(F.col(size) / BUCKET_ROWS))
    rows = df.withColumn("_bucket", F.floor(F.col(key) * buckets))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy(*group, "_bucket").orderBy(key, tie)
    return (
        rows.withColumn("_within", F.row_number().over(within))
        .join(offsets, [*group, "_bucket"])
        .withColumn(rank, F.col("_before") + F.col("_within"))
        .drop("_bucket", "_within", "_before")
    )
