"""Buckets, quotas and deterministic samples: the order of a hash of seed and id stands in for chance."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .ranking import positions, ranked

# Bucket edges and names, and the default shares of each.
LENGTH_EDGES = [2.0, 5.0, 10.0, 20.0]
LENGTH_NAMES = ["<2s", "2-5s", "5-10s", "10-20s", ">20s"]
COVERAGE_EDGES = [0.05, 0.10, 0.20, 0.40]
COVERAGE_NAMES = ["<5%", "5-10%", "10-20%", "20-40%", ">40%"]
LENGTH_SHARES = [0.1325, 0.3232, 0.1940, 0.1410, 0.2094]
COVERAGE_SHARES = [0.3454, 0.2075, 0.1831, 0.1236, 0.1405]


def bucket(value: Column, edges: list[float]) -> Column:
    """The number of the half-open bucket; what is in none (negative, NaN) is in the last."""
    out = F.when((value >= 0) & (value < edges[0]), 0)
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        out = out.when((value >= lo) & (value < hi), i + 1)
    return F.when(value.isNotNull(), out.otherwise(len(edges)))


def quotas(weights: list[float], total: int) -> list[int]:
    """Whole numbers that add up to ``total``, by largest remainder, ties by place.

    Reckoned in fractions, so the whole parts never exceed the total. Raises for no weights, negative ones, ones that add
    up to nothing, and a negative total.
    """
    exact = [Fraction(w) for w in weights]
    whole = sum(exact)
    if total < 0 or whole <= 0 or min(exact) < 0:
        raise ValueError("quotas need a total of 0 or more and weights of 0 or more that add up to more than 0")
    parts = [divmod(w * total / whole, 1) for w in exact]
    base = np.array([int(q) for q, _ in parts])
    remainder = np.array([float(r) for _, r in parts])
    place = np.empty(len(base), int)
    place[np.argsort(-remainder, kind="stable")] = np.arange(len(base))
    return (base + (place < total - base.sum())).tolist()


def hashed(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def unit(hash_: Column) -> Column:
    """The first seven hexadecimal digits of a hash as a number in (0, 1)."""
    return (F.conv(F.substring(hash_, 1, 7), 16, 10).cast("double") + 0.5) / 16.0**7


def _by_number(values: dict[int, float], by: str, default: float) -> Column:
    """The number that goes with a bucket. The bucket, which may be a long expression, is named once."""
    if not values:
        return F.lit(default)
    held = F.create_map(*[x for b, v in values.items() for x in (F.lit(b).cast("long"), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(held, F.col(by).cast("long")), F.lit(default))


def _pools(rows: DataFrame, by: str) -> dict[int, int]:
    """Rows per bucket, one row per bucket."""
    return {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col(by).isNotNull()).collect()}


def smallest_per_bucket(rows: DataFrame, by: str, key: Column, quota: dict[int, int], pools: dict[int, int] | None = None) -> DataFrame:
    """The rows of each bucket that come first by hash, ``quota`` of them at least, with their ``_rank``.

    Only rows under a threshold that holds about twice the quota are written and ranked, in parts of some thousand rows
    (:func:`ranking.ranked`), so neither a bucket nor its quota of any size is a single task. A bucket in which the threshold
    lets through less than it should is ranked whole. ``pools``: the rows per bucket, where they are known.
    """
    pools = _pools(rows, by) if pools is None else pools
    cut = {b: 1.0 if 2 * quota.get(b, 0) + 1000 >= n else (2 * quota.get(b, 0) + 1000) / n for b, n in pools.items()}
    keyed = rows.where(F.col(by).isNotNull()).withColumn("_key", key).withColumn("_unit", unit(F.col("_key")))

    def under() -> DataFrame:
        return materialise(keyed.where(F.col("_unit") < _by_number(cut, by, 0.0)), "near")

    near = under()
    if min(cut.values(), default=1.0) < 1.0:
        through = _pools(near, by)
        short = [b for b, c in cut.items() if c < 1.0 and through.get(b, 0) < quota.get(b, 0)]
        if short:
            cut.update(dict.fromkeys(short, 1.0))
            near = under()
    near = near.withColumn("_unit", F.col("_unit") / _by_number(cut, by, 1.0)).withColumn("_n", _by_number({b: float(pools[b]) * c for b, c in cut.items()}, by, 0.0))
    return ranked(near, [by], "_n", "_unit", "_key", "_rank").drop("_key", "_unit", "_n")


def stratified(rows: DataFrame, by: str, shares: list[float], size: int, seed: int, key: str, oversample: bool = True) -> DataFrame:
    """A sample with the buckets' quotas of ``size``; buckets that are short repeat their rows, or stay short.

    Rows with a NULL bucket are left out. Adds ``copy``, from 0.
    """
    want = dict(enumerate(quotas(shares, size)))
    pools = _pools(rows, by)
    ranked = smallest_per_bucket(rows, by, hashed(seed, key), want, pools)
    copies = F.lit(0)
    for b, n in want.items():
        pool = pools.get(b, 0)
        if pool:
            copies = F.when(F.col(by) == b, F.floor((F.lit(n) - F.col("_rank")) / pool) + 1 if oversample else F.when(F.col("_rank") <= n, 1).otherwise(0)).otherwise(copies)
    taken = ranked.withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies", "_rank")


def summary(rows: DataFrame, by: str, names: list[str], shares: list[float], size: int) -> DataFrame:
    """Per bucket: target, pool, kept and a note of what was repeated."""
    pool = _pools(rows, by)
    out = []
    for i, (name, n) in enumerate(zip(names, quotas(shares, size))):
        have = pool.get(i, 0)
        kept = n if have else 0
        note = "" if n == 0 else "EMPTY" if not have else f"+{n - have} dup" if have < n else ""
        out.append((name, n, have, kept, note))
    return rows.sparkSession.createDataFrame(out, "bucket string, target long, pool long, kept long, note string")


def density(rows: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """``bin`` and its share of all rows; values outside 0..1 count for the outer bins."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(value) * bins).cast("int")))
    n = rows.count()
    return rows.groupBy(b.alias("bin")).agg((F.count("*") / max(n, 1)).alias("share"))


def gaussian(rows: DataFrame, size: int, mu: float, sigma: float, seed: int, key: str, value: str = "difficulty", bins: int = 100) -> DataFrame:
    """A weighted sample without replacement, weight exp(-(d - mu)^2 / 2 sigma^2) over the density of d.

    The rows with the smallest -ln(u) / weight are those that successive weighted draws take. Returns all rows where
    ``size`` is at least their number.
    """
    shares = density(rows, value, bins)
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(value) * bins).cast("int")))
    joined = rows.withColumn("bin", b).join(F.broadcast(shares), "bin")
    weight = F.exp(-(F.col(value) - mu) * (F.col(value) - mu) / (2 * sigma * sigma)) / F.greatest(F.col("share"), F.lit(1e-12))
    order = -F.ln(unit(hashed(seed, key))) / weight
    keyed = materialise(joined.withColumn("order_key", order).drop("bin", "share"), "gaussian")
    n = keyed.count()
    if size >= n:
        return keyed
    # rows far behind the size-th are left out before the rest is put in order, in ranges; the percentile errs by less than the margin
    share = min(1.0, 1.2 * size / n + 0.01)
    cut = keyed.agg(F.percentile_approx("order_key", share, 1000)).first()[0]
    return positions(keyed.where(F.col("order_key") <= cut), "order_key", key).where(F.col("pos") < size).drop("pos")


def task_batches(rows: DataFrame, task: str, size: int, seed: int, key: str) -> DataFrame:
    """Batches of one task each, by hash order within the task, tails dropped: ``round`` and ``task`` give their order."""
    named = rows.withColumn("task", F.coalesce(F.col(task), F.lit("__default__"))).withColumn("_hash", hashed(seed, key))
    sizes = named.groupBy("task").agg(F.count("*").alias("_n"))
    keyed = named.join(sizes, "task").withColumn("_unit", unit(F.col("_hash")))
    placed = ranked(keyed, ["task"], "_n", "_unit", "_hash", "_r").withColumn("round", F.floor((F.col("_r") - 1) / size).cast("long"))
    return placed.where(F.col("round") < F.floor(F.col("_n") / size)).drop("_r", "_n", "_unit", "_hash")
