"""Splitting sequences into parts of even length: sequential within a batch, batches in parallel."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def differencing(lengths: list[int], parts: int, equal: bool) -> list[int]:
    """The part of each item by the largest differencing method (Karmarkar and Karp); ``equal``: parts of equal count.

    A candidate is a list of (sum, items) from large to small; the two of the widest spread are joined, the largest of
    one with the smallest of the other.
    """
    n = len(lengths)
    if equal and n % parts:
        raise ValueError(f"{n} items do not make {parts} parts of equal count")
    order = sorted(range(n), key=lambda i: (lengths[i], i))
    heap: list = []
    pushed = itertools.count()  # candidates that tie are taken in the order they came

    def push(groups: list[tuple[int, list[int]]]) -> None:
        groups.sort(key=lambda g: (-g[0], g[1]))
        heapq.heappush(heap, (groups[-1][0] - groups[0][0], -groups[0][0], next(pushed), groups))

    step = parts if equal else 1
    for at in range(0, n, step):
        own = order[at : at + step]
        push([(lengths[i], [i]) for i in own] + [(0, [])] * (parts - len(own)))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[3], heapq.heappop(heap)[3]
        push([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))])
    out = [0] * n
    for part, (_, items) in enumerate(heap[0][3] if heap else []):
        for i in items:
            out[i] = part
    return out


def greedy(lengths: list[int], parts: int) -> list[int]:
    """Each item, in order, to the part of the smallest sum."""
    sums, out = [(0, p) for p in range(parts)], []
    for n in lengths:
        total, p = heapq.heappop(sums)
        out.append(p)
        heapq.heappush(sums, (total + n, p))
    return out


def balanced(df: DataFrame, batch: str, key: str, length: str, parts: int, method: str = "differencing", equal: bool = False) -> DataFrame:
    """``batch``, ``key``, ``length``, ``part``. A batch is bounded by what a trainer takes at once; NULL lengths count 0."""
    kind = dict(df.dtypes)

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        lengths = pdf[length].fillna(0).astype(int).tolist()
        part = greedy(lengths, parts) if method == "greedy" else differencing(lengths, parts, equal)
        return pd.DataFrame({batch: pdf[batch], key: pdf[key], length: lengths, "part": part})

    return df.select(batch, key, length).groupBy(batch).applyInPandas(split, f"{batch} {kind[batch]}, {key} {kind[key]}, {length} long, part int")


def micro_batches(df: DataFrame, batch: str, key: str, length: str, most: int) -> DataFrame:
    """Parts of a batch, as many as its sum needs at ``most`` a part, the same number for every batch, largest work first."""
    need = df.groupBy(batch).agg(F.count("*").alias("n"), F.sum(length).alias("total"))
    parts = need.agg(F.max(F.least("n", F.ceil(F.col("total") / most)))).first()[0] or 1
    rows = balanced(df, batch, key, length, int(parts))
    work = rows.groupBy(batch, "part").agg(F.sum(F.col(length) * F.col(length)).alias("work"), F.min(key).alias("first"), F.sum(length).alias("total"), F.count("*").alias("items"))
    return work


def shard_sizes(df: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """``key``, ``shard``: keys in order, a new shard where the next would go over ``most`` bytes.

    Where a shard ends depends on all before it, so this is one task; it reads sorted rows batch by batch and holds none of
    them, so its memory has a bound whatever the number of keys.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = held = 0
        for pdf in batches:
            out = []
            for n in pdf[size]:
                if held and held + n > most:
                    shard, held = shard + 1, 0
                held += n
                out.append(shard)
            yield pd.DataFrame({key: pdf[key], size: pdf[size], "shard": out})

    kind = dict(df.dtypes)
    return df.select(key, size).coalesce(1).sortWithinPartitions(key).mapInPandas(cut, f"{key} {kind[key]}, {size} {kind[size]}, shard int")


def even_parts(df: DataFrame, batch: str, key: str, length: str, parts: int) -> DataFrame:
    """Rows of each batch in an order in which equal stretches are parts of even length: ``old_pos`` and ``new_pos`` in the batch,
    ``part``. Raises where a batch does not come out in parts of equal count."""
    rows = balanced(df, batch, key, length, parts, equal=True)
    old, new = Window.partitionBy(batch).orderBy(key), Window.partitionBy(batch).orderBy("part", key)
    return rows.withColumn("old_pos", F.row_number().over(old) - 1).withColumn("new_pos", F.row_number().over(new) - 1)


def imbalance(df: DataFrame, batch: str, key: str, length: str, parts: int) -> DataFrame:
    """Per batch: least and most of the sums of equal stretches of rows as they stand, the same of balanced parts, and the mean.

    The stretches have ``rows // parts`` rows, so one more, shorter, may be left over.
    """
    rows = balanced(df, batch, key, length, parts)
    placed = rows.withColumn("_p", F.row_number().over(Window.partitionBy(batch).orderBy(key)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(batch)))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / parts))
    chunks = placed.groupBy(batch, F.floor(F.col("_p") / step).alias("_c")).agg(F.sum(length).alias("s")).groupBy(batch).agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.sum("s") / parts).alias("mean"))
    sums = rows.groupBy(batch, "part").agg(F.sum(length).alias("s")).groupBy(batch).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"), F.count("*").alias("_used"))
    # a part that no row fell to has a sum of 0
    return chunks.join(sums, batch).select(batch, "min", "max", (F.col("max") - F.col("min")).alias("minmax_diff"), F.when(F.col("_used") < parts, 0).otherwise(F.col("balanced_min")).alias("balanced_min"), "balanced_max", "mean")


def least_parts(total: int, most: int) -> int:
    return math.ceil(total / most)


def by_work(df: DataFrame, batch: str, part: str, key: str, length: str) -> DataFrame:
    """Per part of a batch its work (the sum of squared lengths) and its ``place`` among them: most work first, ties by the larger
    least key."""
    work = df.groupBy(batch, part).agg(F.sum(F.col(length) * F.col(length)).alias("work"), F.min(key).alias("first"))
    return work.withColumn("place", F.row_number().over(Window.partitionBy(batch).orderBy(F.col("work").desc(), F.col("first").desc())) - 1)
