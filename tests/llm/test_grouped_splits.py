import random
from collections import Counter, defaultdict

import pytest

from spanloom.llm import components as C
from spanloom.llm import grouped_splits as S


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"v{rng.randint(0, 120):03}", f"v{rng.randint(0, 120):03}") for _ in range(80)]
    edges += [(f"w{i:03}", f"w{i + 1:03}") for i in range(60)]  # a long chain
    edges += [("hub", f"x{i}") for i in range(50)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges + [(None, "q"), ("v000", "v000")], "a string, b string")).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert C.components(spark.createDataFrame([], "a string, b string")).count() == 0


def records(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        videos = ["hot"] if rng.random() < 0.3 else [f"v{rng.randint(0, n // 3)}"]
        if rng.random() < 0.03:
            videos.append(f"v{rng.randint(0, n // 3)}")
        out.append((i, rng.choice(["tg", "qa", None]), None if i % 50 == 0 else [] if i % 51 == 0 else videos, "clash", "clash"))
    return out


SCHEMA = "record_id long, problem_type string, entities array<string>, component string, group_key string"


def test_groups_and_splits(spark):
    data = records(3000)
    rows = S.grouped(spark.createDataFrame(data, SCHEMA), "record_id", "entities")
    key = brute([(v[0], x) for _, _, v, *_ in data if v for x in v])
    want = {i: key[v[0]] if v else None for i, _, v, *_ in data}
    assert {r.record_id: r.group_key for r in rows.collect()} == want
    n = Counter(k for k in want.values() if k)
    found = {r.record_id for r in S.groups_of_several(rows, "record_id").collect()}
    assert found == {i for i, k in want.items() if k and n[k] > 1}
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.08), ("test", 0.12)], "split string, share double")
    made = S.assign_splits(rows, targets).collect()
    assert sorted(r.record_id for r in made) == [r[0] for r in data]
    of = defaultdict(set)
    for r in made:
        if r.group_key:
            of[r.group_key].add(r.split)
    assert all(len(x) == 1 for x in of.values())
    share = Counter(r.split for r in made)
    assert abs(share["train"] / 3000 - 0.8) < 0.02 and abs(share["test"] / 3000 - 0.12) < 0.02
    again = S.assign_splits(S.grouped(spark.createDataFrame(data[::-1], SCHEMA), "record_id", "entities"), targets).collect()
    assert {(r.record_id, r.split) for r in again} == {(r.record_id, r.split) for r in made}


def test_large_components_by_hash_as_well(spark):
    """With ``large_share`` 1 one rule holds for components of any size."""
    rows = S.grouped(spark.createDataFrame(records(2000, 5), SCHEMA), "record_id", "entities")
    targets = spark.createDataFrame([("train", 0.5), ("val", 0.5)], "split string, share double")
    made = S.assign_splits(rows, targets, large_share=1.0).collect()
    size, of = Counter(r.group_key for r in made if r.group_key), defaultdict(set)
    for r in made:
        of[r.group_key].add(r.split)
    assert all(len(x) == 1 for k, x in of.items() if k) and len(made) == 2000
    share = Counter(r.split for r in made)
    assert abs(share["train"] - 1000) <= max(size.values()) + 40


def test_nothing_and_no_share(spark):
    empty = S.grouped(spark.createDataFrame([], SCHEMA), "record_id", "entities")
    targets = spark.createDataFrame([("train", 1.0)], "split string, share double")
    assert S.groups_of_several(empty, "record_id").count() == 0
    assert S.assign_splits(empty, targets).count() == 0
    with pytest.raises(ValueError):
        S.assign_splits(empty, targets.where("false"))
