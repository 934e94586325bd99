"""Problem 1: a sample whose shares match given targets.

Systematic unequal-probability sampling. Within a plan the categories are sorted and their rows put in
random order; every row has the inclusion probability ``min(1, target / available)`` of its category; a
row is taken where the running sum of probabilities, from one random start, crosses an integer. Since
the probability is one number per category, the running sum follows from the row's rank, and the ranks
come from bucket counts (``operators.ranking``), so no task sees a whole category. Floors are then repaired by
the next rows of the same random order.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from ..operators.ranking import ranked, unit_hash

#: Target rows are configuration; they are read by the driver and sent with every task.
MAX_TARGETS = 10_000


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def eligible_rows(rows: DataFrame) -> DataFrame:
    """Rows with a finite ``difficulty`` in [0, 1] and a finite ``duration`` above 0."""
    d, t = F.col("difficulty"), F.col("duration")
    return rows.where(_finite(d) & d.between(0.0, 1.0) & _finite(t) & (t > 0))


def _categories(targets: list) -> Column:
    """An array of (plan_id, category) of a row; in each plan the first category, by name, that holds it."""
    plans: dict[int, list] = {}
    for t in targets:
        plans.setdefault(t["plan_id"], []).append(t)
    each = []
    for plan, rows in sorted(plans.items()):
        chain = None
        for t in sorted(rows, key=lambda r: r["category"]):
            tests = [F.col("difficulty") >= t["difficulty_lo"]] if t["difficulty_lo"] is not None else []
            tests += [F.col("difficulty") < t["difficulty_hi"]] if t["difficulty_hi"] is not None else []
            tests += [F.col("duration") >= t["duration_lo"]] if t["duration_lo"] is not None else []
            tests += [F.col("duration") < t["duration_hi"]] if t["duration_hi"] is not None else []
            test = reduce(lambda a, b: a & b, tests, F.lit(True))
            chain = (F if chain is None else chain).when(test, F.lit(t["category"]))
        each.append(F.struct(F.lit(plan).cast("int").alias("plan_id"), chain.alias("category")))
    return F.array(*each)


def proportional_sample(
    rows: DataFrame, plans: DataFrame, targets: DataFrame, id_col: str = "record_id", seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """The sample (plan_id, category, id) and the cells it was drawn from, for :func:`sampling_report`.

    ``rows`` holds one row per id with ``difficulty`` and ``duration``; rows that are not eligible are
    ignored, others that fit no category count for the sample size alone. The size of a plan is
    ``sample_per_mille``/1000 of the eligible rows and the target of a category its part by weight, neither
    rounded. A NULL bound is open, a NULL weight or ``min_keep`` counts as 0, a plan without a row in
    ``plans`` or whose weights add up to 0 has targets of 0. Shortfalls are reported,
    not made up elsewhere, so the other categories keep their targets. An empty input gives an empty
    sample and a report of all categories. The same seed gives the same sample.
    """
    wanted = targets.select(
        "plan_id", "category", "difficulty_lo", "difficulty_hi", "duration_lo", "duration_hi",
        F.coalesce("weight", F.lit(0)).cast("double").alias("weight"),
        F.coalesce("min_keep", F.lit(0)).cast("long").alias("min_keep"),
    ).where("plan_id IS NOT NULL AND category IS NOT NULL").dropDuplicates(["plan_id", "category"])
    listed = wanted.limit(MAX_TARGETS + 1).collect()
    if len(listed) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    spark = rows.sparkSession
    pool = eligible_rows(rows).select(F.col(id_col), "difficulty", "duration")
    cells = pool if not listed else materialise(
        pool.select(id_col, F.explode(_categories(listed)).alias("c"))
        .select("c.plan_id", F.coalesce("c.category", F.lit(None).cast("string")).alias("category"), id_col),
        "p1-cells",
    )
    if not listed:
        cells = pool.select(F.lit(0).alias("plan_id"), F.lit("").alias("category"), id_col).where("false")
    counts = cells.groupBy("plan_id", "category").agg(F.count("*").alias("available")).collect()  # one row per target
    eligible: dict[int, int] = {}
    have: dict[tuple, int] = {}
    for r in counts:
        eligible[r["plan_id"]] = eligible.get(r["plan_id"], 0) + r["available"]
        have[(r["plan_id"], r["category"])] = r["available"]
    sizes = plans.select("plan_id", "sample_per_mille").limit(MAX_TARGETS + 1).collect()
    if len(sizes) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} plans")
    mille = {r["plan_id"]: r["sample_per_mille"] or 0 for r in sizes}
    made, base = [], {}
    weights: dict[int, float] = {}
    for t in listed:
        weights[t["plan_id"]] = weights.get(t["plan_id"], 0.0) + t["weight"]
    for t in sorted(listed, key=lambda r: (r["plan_id"], r["category"])):
        p = t["plan_id"]
        n = have.get((p, t["category"]), 0)
        size = mille.get(p, 0) * eligible.get(p, 0) / 1000
        target = size * t["weight"] / weights[p] if weights[p] else 0.0
        at = base.get(p, 0.0)
        base[p] = at + min(target, float(n))
        # the fewest rows that meet the target and the floor
        exact = Fraction(mille.get(p, 0) * eligible.get(p, 0)) * Fraction(t["weight"]) / (1000 * Fraction(weights[p])) if weights[p] else Fraction(0)
        need = max(math.ceil(exact), int(t["min_keep"]))
        made.append((p, t["category"], n, float(target), int(t["min_keep"]), min(1.0, target / n) if n else 0.0, float(at), need))
    cell = spark.createDataFrame(
        made, "plan_id int, category string, available long, target double, min_keep long, _p double, _base double, _need long"
    )
    keyed = cells.join(F.broadcast(cell), ["plan_id", "category"]).withColumn(
        "_key", unit_hash(F.lit(seed), F.col("plan_id"), F.col(id_col))
    )
    start = unit_hash(F.lit(seed), F.lit("start"), F.col("plan_id"))
    rows_ = ranked(keyed, ["plan_id", "category"], "available", "_key", id_col).withColumn("_start", start + F.col("_base"))
    upto = F.floor(F.col("_start") + F.col("rank") * F.col("_p"))
    under = F.floor(F.col("_start") + (F.col("rank") - 1) * F.col("_p"))
    first, last = F.floor("_start"), F.floor(F.col("_start") + F.col("available") * F.col("_p"))
    full = F.col("_p") >= 1.0
    missing = F.least("min_keep", "available") - (last - first)
    rest = F.col("rank") - (upto - first)  # the place among the rows not taken
    sample = rows_.where(full | (upto > under) | (rest <= missing)).select("plan_id", "category", id_col)
    return sample, cell


def sampling_report(sample: DataFrame, cells: DataFrame) -> DataFrame:
    """Per plan and category: ``available``, ``target``, ``min_keep``, ``kept`` (rows of the sample), and ``short``
    where the sample took all rows that are available and still stays below the target or ``min_keep``."""
    kept = materialise(sample.groupBy("plan_id", "category").agg(F.count("*").alias("kept")), "p1-kept")
    taken = F.coalesce("kept", F.lit(0))
    return cells.join(F.broadcast(kept), ["plan_id", "category"], "left").select(
        "plan_id", "category", "available", "target", "min_keep", taken.alias("kept"), ((taken == F.col("available")) & (taken < F.col("_need"))).alias("short")
    )
