"""Balanced parts against a plain restatement of the methods."""

import random

import pytest

from spanloom.operators import balance as L


def plain_differencing(lengths, parts):
    """Largest differencing on sums alone: the two states of the widest spread are joined, large to small."""
    states = [sorted([n] + [0] * (parts - 1), reverse=True) for n in lengths]
    while len(states) > 1:
        states.sort(key=lambda s: s[0] - s[-1])
        a, b = states.pop(), states.pop()
        states.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return states[0]


def test_differencing_spreads_like_the_plain_one():
    rng = random.Random(4)
    for parts in (2, 3, 5):
        for _ in range(40):
            lengths = [rng.randint(1, 10**6) for _ in range(rng.randint(parts, 30))]  # ties are rare, so both go the same way
            sums = [0] * parts
            for n, p in zip(lengths, L.differencing(lengths, parts, False)):
                sums[p] += n
            assert sorted(sums, reverse=True) == plain_differencing(lengths, parts)


def test_equal_counts_and_a_bound():
    rng = random.Random(6)
    for _ in range(40):
        lengths = [rng.randint(1, 1000) for _ in range(24)]
        parts = L.differencing(lengths, 4, True)
        assert sorted(parts) == sorted([0, 1, 2, 3] * 6)
        sums = [sum(n for n, p in zip(lengths, parts) if p == k) for k in range(4)]
        assert max(sums) - min(sums) <= max(lengths)
    with pytest.raises(ValueError):
        L.differencing([1, 2, 3], 2, True)


def test_operators(spark):
    rng = random.Random(1)
    rows = [(b, b * 100 + i, rng.randint(0, 90)) for b in range(3) for i in range(16)]
    df = spark.createDataFrame(rows, "batch long, id long, n long")
    order = L.even_parts(df, "batch", "id", "n", 4).collect()
    for b in range(3):
        own = [r for r in order if r.batch == b]
        assert sorted(r.new_pos for r in own) == sorted(r.old_pos for r in own) == list(range(16)) and all(r.part == r.new_pos // 4 for r in own)
    for r in L.imbalance(df, "batch", "id", "n", 4).collect():
        total = sum(n for b, _, n in rows if b == r.batch)
        assert r.mean == total / 4 and r.balanced_max - r.balanced_min <= r.minmax_diff
    few = L.imbalance(spark.createDataFrame([(1, 1, 5), (1, 2, 7)], "batch long, id long, n long"), "batch", "id", "n", 4).first()
    assert (few.balanced_min, few.balanced_max, few.max) == (0, 7, 7)
