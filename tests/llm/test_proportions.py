import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.llm import proportions as P
from spanloom.operators import ranking as ranks

PLANS = "plan_id int, sample_per_mille int"
TARGETS = "plan_id int, category string, difficulty_lo double, difficulty_hi double, duration_lo double, duration_hi double, weight int, min_keep int"


def draw(spark, rows, plans, targets):
    df = spark.createDataFrame(rows, "record_id long, difficulty double, duration double, category string, rank int, _key double")
    sample, cells = P.proportional_sample(df, spark.createDataFrame(plans, PLANS), spark.createDataFrame(targets, TARGETS))
    return sample.collect(), {(r.plan_id, r.category): r for r in P.sampling_report(sample, cells).collect()}


def rows(n, seed=1):
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf"), -1.0, 2.0]
    return [(i, rng.choice(odd) if i % 9 == 0 else rng.random(), rng.choice(odd[:4]) if i % 11 == 0 else rng.uniform(1, 90), "x", 1, 0.5) for i in range(n)]


TWO = [(1, "easy", None, 0.9, None, None, 3, 5), (1, "hard", 0.9, None, None, None, 7, 5), (2, "a", None, 0.01, None, None, 1, 9), (2, "b", 0.01, None, None, None, 999, 9)]


def test_counts_follow_the_targets(spark):
    data = rows(3000)
    good = [(d, t) for _, d, t, *_ in data if d is not None and t is not None and 0 <= d <= 1 and 0 < t < math.inf]
    sample, report = draw(spark, data, [(1, 500), (2, 100)], TWO)
    for (plan, name), r in report.items():
        inside = [d for d, _ in good if (d < (0.9 if plan == 1 else 0.01)) == (name in ("easy", "a"))]
        size = (0.5 if plan == 1 else 0.1) * len(good)
        weights = {"easy": 0.3, "hard": 0.7, "a": 0.001, "b": 0.999}
        target = size * weights[name]
        assert r.available == len(inside) and abs(r.target - target) < 1e-9
        expected = max(min(target, len(inside)), min(r.min_keep, len(inside)))
        assert abs(r.kept - expected) < 1
        assert r.short == (len(inside) < target or len(inside) < r.min_keep)
        own = [s.record_id for s in sample if (s.plan_id, s.category) == (plan, name)]
        assert len(own) == len(set(own)) == r.kept
    assert report[1, "hard"].short and not report[1, "easy"].short


def test_same_seed_same_sample_whatever_the_partitions(spark):
    data = rows(800)
    first, _ = draw(spark, data, [(1, 300)], TWO[:2])
    second, _ = draw(spark, data[::-1], [(1, 300)], TWO[:2])
    assert set(first) == set(second)


def test_bounds_and_ties(spark):
    data = [(i, 0.5, 10.0, "x", 1, 0.5) for i in range(40)]
    targets = [(1, "below", None, 0.5, None, None, 1, 1), (1, "at", 0.5, None, None, None, 1, 1)]
    sample, report = draw(spark, data, [(1, 500)], targets)
    assert report[1, "below"].available == 0 and report[1, "below"].short
    assert report[1, "at"].available == 40 and report[1, "at"].kept == len(sample) == 10


def test_nothing(spark):
    sample, report = draw(spark, [], [(1, 500)], TWO[:2])
    assert sample == [] and all(r.available == r.kept == 0 and r.short for r in report.values())
    assert draw(spark, rows(50), [], TWO[:2])[1][1, "easy"].target == 0
    assert draw(spark, rows(50), [(1, 500)], []) == ([], {})


def test_ranks_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 16)
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g")).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    df = df.withColumn("k", ranks.unit_hash(F.lit(3), F.col("id")))
    got = ranks.ranked(df, ["g"], "n", "k", "id").collect()
    for g in range(3):
        own = sorted((r for r in got if r.g == g), key=lambda r: (r.k, r.id))
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))


def test_too_many_plans_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_TARGETS", 4)
    with pytest.raises(ValueError, match="plans"):
        draw(spark, rows(50), [(i, 500) for i in range(5)], TWO)
    assert draw(spark, rows(50), [(i, 500) for i in range(4)], TWO)[1][1, "easy"].target > 0
