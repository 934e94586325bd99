import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import sequences as S
from spanloom.operators import balance, batch, checkpoints, groups, intervals, metrics, sampling
from spanloom.operators.ranking import positions


def test_positions_with_ties_and_nulls(spark):
    rows = [(i, None if i % 5 == 0 else i % 7) for i in range(500)]
    got = positions(spark.createDataFrame(rows, "id int, k int"), F.col("k").asc_nulls_first(), F.col("id")).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [r.id for r in sorted(got, key=lambda r: r.pos)] == [w[0] for w in want]


def test_positions_of_nothing(spark):
    assert positions(spark.createDataFrame([], "id int"), "id").count() == 0


def test_quotas_add_up():
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.random() for _ in range(rng.randint(1, 9))]
        n = rng.randint(0, 1000)
        got = sampling.quotas(w, n)
        assert sum(got) == n and all(abs(g - x / sum(w) * n) < 1 for g, x in zip(got, w))
    assert sampling.quotas(sampling.LENGTH_SHARES, 997) == [132, 322, 193, 141, 209]


def test_stratified_counts(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 4).cast("int").alias("b"))
    s = sampling.stratified(rows, "b", [1, 2, 3, 4], 4000, 1, "id").groupBy("b").count().collect()
    assert {r.b: r["count"] for r in s} == {0: 400, 1: 800, 2: 1200, 3: 1600}
    short = sampling.stratified(rows, "b", [1, 2, 3, 4], 4000, 1, "id", oversample=False).groupBy("b").count().collect()
    assert {r.b: r["count"] for r in short} == {0: 400, 1: 500, 2: 500, 3: 500}


def test_group_means(spark):
    rows = [(i // 8, i % 8, float((i * 37) % 11)) for i in range(400)]
    df = spark.createDataFrame(rows, "uid int, slot int, score double")
    for name in ("grpo", "rloo"):
        sums = groups.advantages(name, df).groupBy("uid").agg(F.sum("advantage").alias("s")).collect()
        assert all(abs(r.s) < 1e-6 for r in sums)


def test_group_of_one(spark):
    df = spark.createDataFrame([(1, 0, 2.0)], "uid int, slot int, score double")
    with pytest.raises(Exception):
        groups.advantages("grpo", df).collect()
    assert groups.advantages("rloo", df, on_singleton="null").first().advantage is None
    with pytest.raises(NotImplementedError):
        groups.advantages("none", df)


def test_diagnostics_without_groups(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0, True)], "uid int, score double, advantage double, is_gt boolean")
    assert groups.injection_diagnostics(df).where("metric <> 'n_groups'").where("value > 0").count() == 0


def test_scans(spark):
    rows = [([1.0, 2.0, 3.0], [1.0, 1.0, 0.0]), ([], []), ([5.0], [1.0])]
    got = spark.createDataFrame(rows, "r array<double>, m array<double>").select(S.to_go(F.col("r"), 0.5, F.col("m"))).collect()
    assert [r[0] for r in got] == [[2.0, 2.0, 3.0], [], [5.0]]


def test_response_mask(spark):
    got = spark.createDataFrame([([0, 0, 2, 4, 3, 5, 1, 0, 0],), ([],)], "t array<int>").select(S.response_mask(F.col("t"), [1])).collect()
    assert [r[0] for r in got] == [[1] * 7 + [0] * 2, []]


def test_media_positions():
    got = S.media_positions([1, 1, 9, 9, 9, 9, 1], [(1, 4, 4, 0)], 9, 8, 2)
    assert got.tolist() == [[0, 1, 2, 2, 2, 2, 4], [0, 1, 2, 2, 3, 3, 4], [0, 1, 2, 3, 2, 3, 4]]


def test_merge_is_idempotent(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 3), a := rng.randint(0, 80), a + rng.randint(-3, 6)) for _ in range(200)]
    once = intervals.merged(spark.createDataFrame(rows, "g int, a int, b int"), "g")
    twice = intervals.merged(once, "g")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    for g in range(4):
        s = sorted((r.a, r.b) for r in once.collect() if r.g == g)
        assert all(y[0] - x[1] >= 2 for x, y in zip(s, s[1:]))


def test_densify_outside_keyframes(spark):
    k = spark.createDataFrame([("v", 5, 10.0), ("v", 8, 20.0)], "g string, frame long, x double")
    got = {r.frame: r.x for r in intervals.densified(k, "g", 3, 10).collect()}
    assert got == {3: 10.0, 4: 10.0, 5: 10.0, 6: 13.0, 7: 17.0, 8: 20.0, 9: 20.0, 10: 20.0}


def test_differencing_covers_and_balances():
    rng = random.Random(5)
    lengths = [rng.randint(1, 900) for _ in range(64)]
    for equal in (True, False):
        part = balance.differencing(lengths, 8, equal)
        sums = [sum(n for n, p in zip(lengths, part) if p == k) for k in range(8)]
        assert max(sums) - min(sums) < 120
        if equal:
            assert [part.count(k) for k in range(8)] == [8] * 8
    with pytest.raises(ValueError):
        balance.differencing([1, 2, 3], 2, True)
    assert balance.differencing([], 3, False) == []


def test_union_conflict(spark):
    a = spark.createDataFrame([(0, 1), (1, 2)], "pos int, x int")
    assert batch.united(a, a.withColumn("y", F.lit(3)), "pos").count() == 2
    with pytest.raises(Exception):
        batch.united(a, a.withColumn("x", F.lit(9)), "pos").collect()
    with pytest.raises(Exception):
        batch.united(a, a.where("pos = 0"), "pos").collect()


def test_padding(spark):
    df = spark.range(5).withColumnRenamed("id", "pos").withColumn("v", F.col("pos") * 10)
    out, added = batch.padded(df, 4, 5)
    assert added == 3 and sorted(r.v for r in out.collect()) == [0, 0, 10, 10, 20, 20, 30, 40]
    few, added = batch.padded(df.where("pos < 2"), 7, 2)
    assert added == 5 and few.count() == 7


def test_retention(spark):
    steps = spark.createDataFrame([(s,) for s in (10, 20, 30, 40, 50)], "step int")
    keep = {r.step for r in checkpoints.retained(steps, 50, 10, 3).where("keep").collect()}
    assert keep == {10, 40}
    assert checkpoints.retained(steps, 50, 10, 0).where("keep").count() == 4


def test_flat_and_nested(spark):
    m = spark.createDataFrame([("a/b/c", 1.0), ("a/d", 2.0), ("e", 3.0)], "metric string, value double")
    assert {tuple(r) for r in metrics.flat(metrics.nested(m)).collect()} == {("a/b/c", 1.0), ("a/d", 2.0), ("e", 3.0)}
