"""Problem 3: splits that keep related records together.

Records are linked by the entities (videos) they share. Only records with several entities link entities,
so the graph has an edge from a record's smallest entity to each of its others, and a record belongs to the
component of its smallest entity. Components come from alternating large-star and small-star steps.

Within a stratum (a component's most frequent problem type) components stand in the order of a hash of their
key; the running sum of their sizes, scaled to [0, 1), falls into the ranges of the split shares, and the
range decides the split. Components too large for that (over ``LARGE`` of all records, so less than 1/LARGE
of them) are given first, largest first, to the split with the most room, and the ranges of the strata shrink
by what these took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .components import components
from ..operators.ranking import unit_hash

#: Strata are kinds of records; their list is held by the driver and sent with every task.
MAX_STRATA = 10_000
#: Share of all records from which a component is placed by itself, unless the caller names another.
LARGE = 0.004
#: Records that one bucket of components in hash order is meant to hold.
BUCKET_RECORDS = 4096


def grouped(records: DataFrame, id_col: str, entities: str) -> DataFrame:
    """Adds ``group_key``: the smallest entity of the component; NULL for records without an entity.

    ``records`` holds one row per id; ``entities`` is an array of strings. NULL and empty arrays, and NULL
    elements, link nothing. Other columns are kept, one named ``group_key`` is replaced.
    """
    records = records.drop("group_key", "_first", "_component")
    ids = F.array_sort(F.array_distinct(F.filter(F.col(entities), lambda x: x.isNotNull())))
    rows = records.withColumn("_first", F.when(F.size(ids) > 0, ids[0]))
    several = rows.where(F.size(ids) > 1)
    edges = several.select(F.col("_first").alias("a"), F.explode(F.slice(ids, F.lit(2), F.size(ids))).alias("b"))
    found = components(edges).select(F.col("node").alias("_first"), F.col("component").alias("_component"))
    # A popular entity may hold a third of the rows: AQE splits its side of this join; the other has one row per entity.
    return rows.join(found, "_first", "left").withColumn("group_key", F.coalesce("_component", "_first")).drop("_first", "_component")


def group_sizes(rows: DataFrame) -> DataFrame:
    """``group_key``, ``records``; counted before the shuffle, so a large group is a few rows."""
    return rows.where("group_key IS NOT NULL").groupBy("group_key").agg(F.count("*").alias("records"))


def groups_of_several(rows: DataFrame, id_col: str) -> DataFrame:
    """``id``, ``group_key`` of the records whose group has two or more ids."""
    several = group_sizes(rows).where("records >= 2").select("group_key")
    return rows.join(several, "group_key", "left_semi").select(id_col, "group_key")


def assign_splits(rows: DataFrame, targets: DataFrame, id_col: str = "record_id", stratum: str = "problem_type", seed: int = 23, large_share: float = LARGE) -> DataFrame:
    """``id``, ``group_key``, ``split``: every group whole in one split, in the shares of ``targets``.

    ``targets``: ``split``, ``share`` (shares are scaled to add up to 1; NULL or negative ones count as 0).
    Components of over ``large_share`` of all records are placed by room; with 1 all go by hash, and the shares are off by as
    much as the largest component has. Records without an entity are a group of their own, ``group_key`` NULL. NULL strata are a stratum.
    The result does not depend on the order or partitioning of the input. An empty input gives an empty
    result; without a positive share, or with more than ``MAX_STRATA`` strata, it raises ValueError.
    """
    shares = [(r["split"], max(0.0, r["share"] or 0.0)) for r in targets.select("split", "share").orderBy("split").collect()]
    total_share = sum(s for _, s in shares)
    if total_share <= 0:
        raise ValueError("no positive share")
    shares = [(n, s / total_share) for n, s in shares]
    unit = F.coalesce(F.col("group_key"), F.concat(F.lit("\x00"), F.col(id_col).cast("string")))
    base = rows.select(id_col, "group_key", F.coalesce(F.col(stratum), F.lit("")).alias("_s"), unit.alias("_u"))
    per = base.groupBy("_u", "_s").agg(F.count("*").alias("_n"))
    comp = materialise(
        per.groupBy("_u").agg(F.sum("_n").alias("_n"), F.max_by("_s", F.struct("_n", "_s")).alias("_s")), "components"
    )
    strata = {r["_s"]: r["n"] for r in comp.groupBy("_s").agg(F.sum("_n").alias("n")).limit(MAX_STRATA + 1).collect()}
    if len(strata) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    total = sum(strata.values())
    large = comp.where(F.col("_n") > large_share * total).collect() if total and large_share < 1 else []  # fewer than 1 / large_share rows
    room = {(s, n): strata[s] * share for s in strata for n, share in shares}
    placed = []
    for r in sorted(large, key=lambda r: (-r["_n"], r["_u"])):
        # the split short of most records in all, with the own stratum as tie-break
        best = max(shares, key=lambda x: (sum(room[(s, x[0])] for s in strata), room[(r["_s"], x[0])], x[0]))[0]
        room[(r["_s"], best)] -= r["_n"]
        placed.append((r["_u"], best))
    ranges = []
    for s in strata:
        left = [(n, max(0.0, room[(s, n)])) for n, _ in shares]
        whole, at = sum(v for _, v in left), 0.0
        for n, v in left:
            part = v / whole if whole else 1.0 / len(left)
            ranges.append((s, n, at, at + part))
            at += part
        ranges[-1] = (*ranges[-1][:3], 2.0)
    spark = rows.sparkSession
    ranges_df = spark.createDataFrame(ranges, "_s string, split string, _lo double, _hi double")
    placed_df = spark.createDataFrame(placed, "_u string, split string")
    small = comp.join(F.broadcast(placed_df.select("_u")), "_u", "left_anti").withColumn("_h", unit_hash(F.lit(seed), F.col("_u")))
    sizes = small.groupBy("_s").agg(F.sum("_n").alias("_total"))
    bucketed = small.join(F.broadcast(sizes), "_s").withColumn(
        "_b", F.floor(F.col("_h") * F.greatest(F.lit(1.0), F.ceil(F.col("_total") / BUCKET_RECORDS)))
    )
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("_s", "_b").agg(F.sum("_n").alias("_k")).withColumn("_o", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    within = Window.partitionBy("_s", "_b").orderBy("_h", "_u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed_small = (
        bucketed.withColumn("_cum", F.sum("_n").over(within)).join(offsets, ["_s", "_b"])
        .withColumn("_x", (F.col("_o") + F.col("_cum") - F.col("_n") / 2) / F.col("_total"))
        .join(F.broadcast(ranges_df), "_s").where("_x >= _lo AND _x < _hi").select("_u", "split")
    )
    return base.join(placed_small.unionByName(placed_df), "_u").select(id_col, "group_key", "split")
