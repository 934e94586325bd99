import math
import os
import random

import pytest

from spanloom.llm import queries as Q
from spanloom.llm import packing as P


def test_group_is_near_the_least():
    rng = random.Random(3)
    for low, high, over in ((1, 100, 1.0), (50, 350, 1.0), (200, 600, 1.02)):
        items = [(rng.randint(low, high), i) for i in range(300)]
        bins = P.pack_group(items, 1000)
        assert sorted(x for b in bins for x in b) == sorted(items)
        assert all(sum(s for s, _ in b) <= 1000 for b in bins)
        assert len(bins) <= math.ceil(sum(s for s, _ in items) / 1000) * over


def test_search_empties_a_container():
    items = [(s, i) for i, s in enumerate([44, 24, 24, 22, 21, 17, 8, 8, 6, 6])]  # best fit takes four containers of 60
    assert len(P._best_fit(items, 60)) == 4 and len(P.pack_group(items, 60)) == 3
    rng = random.Random(8)
    first = second = 0
    for _ in range(20):
        items = [(rng.randint(200, 600), i) for i in range(120)]
        first, second = first + len(P._best_fit(items, 1000)), second + len(P.pack_group(items, 1000))
    assert second < first


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_CONTAINERS", 8)
    rng = random.Random(4)
    docs = [(i, rng.choice([0, rng.randint(1, 90), 100, 200, 250])) for i in range(600)] + [(None, 7), (9001, None)]
    plans = spark.createDataFrame([(1, "a", 100), (2, "b", 1000), (3, "c", None), (1, "again", 100)], "plan_id int, plan_name string, capacity_tokens int")
    packed = P.pack(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, tokens int, container string, piece int"), plans)
    rows = packed.collect()
    for plan, cap in ((1, 100), (2, 1000)):
        own = [r for r in rows if r.plan_id == plan]
        for i, n in docs:
            mine = sorted((r.piece, r.tokens) for r in own if r.doc_id == i)
            assert sum(t for _, t in mine) == (n or 0) and [p for p, _ in mine] == list(range(1, len(mine) + 1))
            assert len(mine) == max(1, math.ceil((n or 0) / cap))
        fill = {}
        for r in own:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
        assert max(fill.values()) <= cap
        assert len(fill) <= 1.08 * math.ceil(sum(n or 0 for _, n in docs) / cap) + 1
    assert {r.plan_id for r in rows} == {1, 2}
    assert P.report(packed, plans.where("plan_name <> 'again'")).count() == 2
    assert P.pack(spark.createDataFrame([], "doc_id long, tokens int"), plans).count() == 0
    assert P.pack(spark.createDataFrame([(1, 5)], "doc_id long, tokens int"), plans.where("false")).count() == 0


def test_open_containers_meet_other_groups(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_CONTAINERS", 4)
    rng = random.Random(9)
    docs = [(i, rng.randint(30, 60)) for i in range(400)]  # most containers stay open at first
    packed = P.pack(spark.createDataFrame(docs, "doc_id long, tokens int"), spark.createDataFrame([(1, 100)], "plan_id int, capacity_tokens int"))
    rows = packed.collect()
    assert sorted((r.doc_id, r.tokens) for r in rows) == docs
    assert len({r.container_id.split("-")[1] for r in rows}) > 1


@pytest.mark.parametrize("folder", [f"/root/testdata/{sf}" for sf in ("sf0.01", "sf0.1")])
def test_containers_of_the_documents_are_near_the_least(spark, folder):
    if not os.path.isdir(folder):
        pytest.skip("no such tables")
    for r in Q.p6_report(spark, folder).collect():
        assert r.least <= r.containers <= 1.005 * r.least + 1 and r.fullest <= {p.plan_id: p.capacity_tokens for p in Q.table(spark, folder, "pack_plans").collect()}[r.plan_id]


def test_all_plans_in_the_same_passes_and_more_than_one_task(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_CONTAINERS", 4)
    rng = random.Random(2)
    docs = [(i, rng.randint(1, 80)) for i in range(500)]
    seen = []
    write = P.materialise
    monkeypatch.setattr(P, "materialise", lambda df, label="": (seen.append((label, df.rdd.getNumPartitions())), write(df, label))[1])
    plans = [(1, 100), (2, 300), (3, 5000)]
    rows = P.pack(spark.createDataFrame(docs, "doc_id long, tokens int"), spark.createDataFrame(plans, "plan_id int, capacity_tokens int")).collect()
    assert sorted((r.plan_id, r.doc_id, r.tokens) for r in rows) == [(p, *d) for p, _ in plans for d in docs]
    assert len({r.container_id for r in rows}) >= sum(math.ceil(sum(n for _, n in docs) / c) for _, c in plans)
    assert [label for label, _ in seen].count("packed") < 8 and max(n for label, n in seen if label == "packed") > 8


def test_too_many_plans_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_PLANS", 1)
    with pytest.raises(ValueError, match="plans"):
        P.pack(spark.createDataFrame([(1, 5)], "doc_id long, tokens int"), spark.createDataFrame([(1, 10), (2, 10)], "plan_id int, capacity_tokens int"))
