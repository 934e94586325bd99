"""Problem 6: filling containers of fixed capacity.

Items are spread over groups by hash, each of about ``GROUP_CONTAINERS`` containers, and each group is packed by
best fit, largest first, then improved by local search: underfull containers, fullest first, take items of others no
fuller, alone, for one or for two of their own, wherever the sum of squared fills grows, until containers are empty. The containers that
stay open are taken up again, with their items, by groups of the next round, until one group holds them all or a round
leaves them no fewer.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: Containers of a group, on average.
GROUP_CONTAINERS = 256
#: Passes over a group's containers at most.
ROUNDS = 40
#: Share of the capacity that may be free in a container that is not taken up again.
CLOSED_FREE = 0.004
#: More plans than these are an error; and the most tasks that a pass is cut into.
MAX_PLANS, MAX_TASKS = 1000, 20_000


class _Bin:
    __slots__ = ("free", "items")

    def __init__(self, free: int):
        self.free, self.items = free, []  # items: (size, key), sorted

    def take(self, item):
        insort(self.items, item)
        self.free -= item[0]


def _best_fit(items: list[tuple], capacity: int) -> list[_Bin]:
    bins: list[_Bin] = []
    open_: list[tuple[int, int]] = []  # (free, number), sorted
    for item in sorted(items, reverse=True):
        k = bisect_left(open_, (item[0], -1))
        if k < len(open_):
            _, n = open_.pop(k)
        else:
            n = len(bins)
            bins.append(_Bin(capacity))
        bins[n].take(item)
        if bins[n].free:
            insort(open_, (bins[n].free, n))
    return bins


class _Search:
    """Exchanges between underfull containers; every one makes a container fuller at the cost of one no fuller, so that
    the sum of squared fills grows."""

    def __init__(self, bins: list[_Bin], capacity: int):
        self.bins, self.capacity = bins, capacity
        self.pool = sorted((size, n, key) for n, b in enumerate(bins) if b.free for size, key in b.items)  # of underfull ones

    def _offer(self, low: int, high: int, n: int) -> tuple | None:
        """The largest item of low < size <= high in another container with no less room than ``n`` has."""
        k = bisect_right(self.pool, (high, len(self.bins) + 1)) - 1
        while k >= 0 and self.pool[k][0] > low:
            other = self.pool[k][1]
            if other != n and self.bins[other].free >= self.bins[n].free:
                return self.pool[k]
            k -= 1
        return None

    def _shift(self, item: tuple, source: int, target: int) -> None:
        self.bins[source].items.remove(item)
        self.bins[source].free += item[0]
        self.pool.pop(bisect_left(self.pool, (item[0], source, item[1])))
        self.bins[target].take(item)
        insort(self.pool, (item[0], target, item[1]))

    def fill(self, n: int) -> bool:
        """The best exchange that makes container ``n`` fuller: a move, one for one, or one for two of its own."""
        own, room = self.bins[n].items, self.bins[n].free
        best: tuple = (0,)
        give: list[tuple[int, tuple]] = [(0, ())] + [(x[0], (x,)) for x in own]
        give += [(own[i][0] + own[j][0], (own[i], own[j])) for j in range(len(own)) for i in range(j)]
        for size, items in give:
            offer = self._offer(size, size + room, n)
            if offer is not None and offer[0] - size > best[0]:
                best = (offer[0] - size, items, offer)
                if best[0] == room:
                    break
        if not best[0]:
            return False
        _, items, (size, other, key) = best
        self._shift((size, key), other, n)
        for x in items:
            self._shift(x, n, other)
        if not self.bins[n].free:  # full: out of the search
            self.pool = [x for x in self.pool if x[1] != n]
        return True

    def run(self, least: int) -> None:
        """Until the containers are as few as can be, or no exchange is left."""
        for _ in range(ROUNDS):
            changed = False
            for n in sorted(range(len(self.bins)), key=lambda n: (self.bins[n].free, n)):
                while 0 < self.bins[n].free < self.capacity and self.fill(n):
                    changed = True
            if not changed or sum(bool(b.items) for b in self.bins) <= least:
                return


def pack_group(items: list[tuple], capacity: int) -> list[list[tuple]]:
    """Containers, as lists of items (size, key), of one group. Sizes are from 0 to the capacity."""
    zero = [x for x in items if x[0] == 0]
    bins = _best_fit([x for x in items if x[0] > 0], capacity)
    least = math.ceil(sum(x[0] for x in items) / capacity)
    if len(bins) > least:
        _Search(bins, capacity).run(least)
    out = [b.items for b in bins if b.items]
    if zero:
        if not out:
            out.append([])
        out[-1] = out[-1] + zero
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity, group = int(pdf["capacity"].iloc[0]), int(pdf["group"].iloc[0])
    keys = list(zip(pdf["doc_id"], pdf["piece"], pdf["pieces"]))
    rows = []
    order = sorted(range(len(keys)), key=lambda i: (keys[i][0] is not None, keys[i]) if keys[i][0] is not None else (False, ("", *keys[i][1:])))
    for n, items in enumerate(pack_group([(int(pdf["size"].iloc[i]), place) for place, i in enumerate(order)], capacity)):
        free = capacity - sum(x[0] for x in items)
        rows += [(int(pdf["plan_id"].iloc[0]), capacity, group << 24 | n, free, *keys[order[k]], s) for s, k in items]
    return pd.DataFrame(rows, columns=["plan_id", "capacity", "container", "free", "doc_id", "piece", "pieces", "size"])


_PACKED = "plan_id int, capacity int, container long, free int, doc_id string, piece int, pieces int, size int"


def _wanted(plans: DataFrame) -> dict[int, int]:
    """The capacity of each plan, the largest where it is listed more than once."""
    rows = (
        plans.where("capacity_tokens > 0 AND plan_id IS NOT NULL").groupBy("plan_id").agg(F.max("capacity_tokens").alias("capacity"))
        .orderBy("plan_id").limit(MAX_PLANS + 1).collect()
    )
    if len(rows) > MAX_PLANS:
        raise ValueError(f"more than {MAX_PLANS} plans")
    return {r["plan_id"]: r["capacity"] for r in rows}


def pack(sizes: DataFrame, plans: DataFrame, seed: int = 5) -> DataFrame:
    """``plan_id``, ``container_id``, ``doc_id``, ``piece``, ``pieces``, ``tokens``: where each document, or piece, goes.

    ``sizes``: ``doc_id``, ``tokens``, one row per document; NULL counts as 0. A document over the capacity is cut into
    pieces of the capacity, each a container of its own, and a rest that is packed like others; no other is cut.
    Documents of 0 tokens take no room in some container, documents without an id are packed like others. Plans whose capacity is NULL or not positive hold nothing;
    a plan that is listed with several capacities has the largest. Equal input gives equal containers. Empty input gives none. All plans are packed in the same passes.
    """
    spark = sizes.sparkSession
    capacity = _wanted(plans)
    if not capacity:
        return spark.createDataFrame([], "plan_id int, container_id string, doc_id long, piece int, pieces int, tokens int")
    size = F.coalesce("tokens", F.lit(0)).cast("int")
    docs = materialise(sizes.select(F.col("doc_id").cast("string").alias("doc_id"), size.alias("size")), "sizes")  # as text, so that NULL ids survive pandas
    every = F.array(*[F.struct(F.lit(p).cast("int").alias("plan_id"), F.lit(c).cast("int").alias("capacity")) for p, c in capacity.items()])
    cap = F.col("capacity")
    cut = docs.select("doc_id", "size", F.explode(every).alias("p")).select("doc_id", "size", "p.plan_id", "p.capacity").withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("size") / cap)).cast("int"))
    whole, rest = F.floor(F.col("size") / cap).cast("int"), (F.col("size") % cap).cast("int")
    done = [cut.where(F.col("size") >= cap).select(
        "plan_id", F.explode(F.sequence(F.lit(1), whole)).alias("piece"), "pieces", "doc_id", F.col("capacity").alias("tokens")
    ).withColumn("container_id", F.concat_ws("-", F.lit("full"), "plan_id", "doc_id", "piece"))]
    items = cut.where((F.col("size") < cap) | (rest > 0)).select(
        "plan_id", "capacity", "doc_id", F.when(F.col("size") < cap, F.lit(1)).otherwise(F.col("pieces")).alias("piece"), "pieces", rest.alias("size"))
    total = docs.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    held = {p: total for p in capacity}  # tokens of each plan that are still to be packed
    opened: dict[int, int] = {}  # how many containers of a plan the last level left open, and, in before, where their documents were
    before, level = None, 0
    closed = F.col("free") <= CLOSED_FREE * cap
    place = ["plan_id", "piece", "pieces", "doc_id", F.col("size").alias("tokens"), "container_id"]
    while held:
        groups = {p: max(1, math.ceil(n / capacity[p] / GROUP_CONTAINERS)) for p, n in held.items()}
        of = F.element_at(F.create_map(*[F.lit(x).cast("int") for pair in groups.items() for x in pair]), F.col("plan_id"))
        keyed = items.withColumn("group", F.pmod(F.xxhash64(F.lit(seed + level), "doc_id"), of).cast("int"))
        # so many partitions that a task has a few groups; left to their bytes, all of them would be one task
        packed = materialise(
            keyed.repartition(min(MAX_TASKS, max(1, sum(groups.values()) // 2)), "plan_id", "group").groupBy("plan_id", "group").applyInPandas(_pack, _PACKED), "packed"
        ).withColumn("container_id", F.concat_ws("-", F.lit("r"), F.lit(level), "plan_id", "container"))
        stats = {r["plan_id"]: r for r in packed.groupBy("plan_id", "container").agg(F.first("free").alias("free"), F.first("capacity").alias("capacity"), F.sum(F.col("size").cast("long")).alias("size"))
                 .groupBy("plan_id").agg(F.count("*").alias("all"), F.sum((~closed).cast("int")).alias("open"), F.sum(F.when(~closed, F.col("size")).otherwise(0)).alias("size")).collect()}
        # a plan goes on where this level has taken fewer containers than were open, and more than one group has open ones
        worse = [p for p in held if p in opened and (p not in stats or stats[p]["all"] >= opened[p])]
        ended = [p for p in held if p in stats and p not in worse and (groups[p] == 1 or stats[p]["open"] <= 1)]
        again = [p for p in held if p in stats and p not in worse and p not in ended]
        if worse:
            done.append(before.where(F.col("plan_id").isin(worse)))
        if ended or again:
            done.append(packed.where(F.col("plan_id").isin(ended) | (F.col("plan_id").isin(again) & closed)).select(*place))
        open_ = packed.where(F.col("plan_id").isin(again) & ~closed)
        before, items = open_.select(*place), open_.select("plan_id", "capacity", "doc_id", "piece", "pieces", "size")
        held, opened, level = {p: stats[p]["size"] for p in again}, {p: stats[p]["open"] for p in again}, level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("plan_id", "container_id", F.col("doc_id").cast("long").alias("doc_id"), "piece", "pieces", "tokens")


def report(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """Per plan: documents, containers, the least number any packing needs, tokens, and the share of room that is filled."""
    by = packed.groupBy("plan_id", "container_id").agg(F.sum("tokens").alias("tokens"))
    used = by.groupBy("plan_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    room = F.col("capacity_tokens")
    return used.join(F.broadcast(plans.select("plan_id", "capacity_tokens")), "plan_id").select(
        "plan_id", "containers", F.ceil(F.col("tokens") / room).alias("least"), "tokens", "fullest",
        F.round(F.col("tokens") / (F.col("containers") * room), 5).alias("filled"))
