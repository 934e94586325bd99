"""The algebra of columnar batches: union, concatenation, chunks, repeats, padding, reordering.

Row order is a column (``pos``), never the order of the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; unknown names are ignored."""
    return df.select([n for n in names if n in df.columns])


def popped(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The named columns, and the rest."""
    return df.select(names), df.drop(*names)


def renamed(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old names, {len(new)} new ones")
    return df.withColumnsRenamed(dict(zip(old, new)))


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All rows; columns that a part lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def conflicts(a: DataFrame, b: DataFrame, key: str) -> Column:
    """A condition that two joined rows (aliases a, b) differ in a column that both have."""
    both = [c for c in a.columns if c in b.columns and c != key]
    return reduce(lambda x, y: x | y, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in both], F.lit(False))


def united(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The columns of both, by row key. Raises where a shared column differs or a row is in one only."""
    new = [c for c in b.columns if c not in a.columns]
    rows = a.withColumn("_in_a", F.lit(1)).alias("a").join(b.withColumn("_in_b", F.lit(1)).alias("b"), key, "full")
    bad = F.col("_in_a").isNull() | F.col("_in_b").isNull() | conflicts(a, b, key)
    out = rows.select(key, *[F.col(f"a.{c}") for c in a.columns if c != key], *[F.col(f"b.{c}") for c in new], bad.alias("_bad"))
    return out.where(F.when(F.col("_bad"), F.raise_error(F.lit("batches differ")).cast("boolean")).otherwise(F.lit(True))).drop("_bad")


def chunked(df: DataFrame, chunks: int, rows: int, pos: str = "pos") -> DataFrame:
    """Adds ``chunk``: equal stretches of ``rows`` rows in all. Raises where they do not come out even."""
    if rows % chunks:
        raise ValueError(f"{rows} rows do not make {chunks} equal chunks")
    return df.withColumn("chunk", F.floor(F.col(pos) / (rows // chunks)).cast("int"))


def repeated(df: DataFrame, times: int, interleave: bool, rows: int, pos: str = "pos") -> DataFrame:
    """Each row ``times`` times: AABB when interleaved, else ABAB. Adds ``copy`` and the new ``pos``."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    place = F.col(pos) * times + F.col("copy") if interleave else F.col("copy") * rows + F.col(pos)
    return out.withColumn(pos, place.cast("long"))


def padded(df: DataFrame, divisor: int, rows: int, pos: str = "pos") -> tuple[DataFrame, int]:
    """Rows from the head, over and over, up to a multiple of ``divisor``; and how many were added."""
    if not rows:
        return df, 0
    missing = -rows % divisor
    copies = F.explode(F.sequence(F.lit(0), F.floor((F.lit(missing - 1) - F.col(pos)) / rows).cast("int")))
    extra = df.where(F.col(pos) < missing).withColumn("_c", copies).withColumn(pos, (F.col(pos) + rows + F.col("_c") * rows).cast("long")).drop("_c")
    return df.unionByName(extra), missing


def reordered(df: DataFrame, order: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows in the places of ``order`` (``pos``, ``new_pos``)."""
    return df.join(order, pos).drop(pos).withColumnRenamed("new_pos", pos)


def mini_batches(df: DataFrame, size: int, rows: int, epochs: int, pos: str = "pos") -> DataFrame:
    """``epoch`` and ``batch`` of each row, every epoch in the same order. Raises where batches do not come out even."""
    if rows % size:
        raise ValueError(f"{rows} rows do not make batches of {size}")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("batch", F.floor(F.col(pos) / size).cast("int"))


def folded(df: DataFrame, chunks: int, rows: int, value: str, pos: str = "pos") -> DataFrame:
    """One row per chunk with the values of its rows in their order."""
    return chunked(df, chunks, rows, pos).groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias(value))


def missing_keys(base: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    return base.select(key).distinct().join(merged, key, "left_anti")


def kept_keys(base: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    return base.select(key).distinct().join(merged, key, "left_semi")


def backfilled(merged: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """The merged value where there is one, else the base's, with its origin."""
    a, b = merged.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in")), base.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full").select(key, F.coalesce("_a", "_b").alias(value), F.when(F.col("_in"), "merged").otherwise("base").alias("origin"))


def extra_keys(base: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Keys of the merged table that the base lacks."""
    return missing_keys(merged, base, key)


def index_selected(df: DataFrame, index: DataFrame, pos: str = "pos") -> DataFrame:
    """The rows at the places of ``index`` (``place``, ``pos``), as often as they are listed; ``place`` gives their order. Negative places count
    from the end."""
    n = df.count()
    wanted = index.select("place", F.when(F.col("pos") < 0, F.col("pos") + n).otherwise(F.col("pos")).alias("_at"))
    return wanted.join(df, F.col("_at") == F.col(pos)).drop("_at")


def sliced(df: DataFrame, start: int, end: int, step: int = 1, pos: str = "pos") -> DataFrame:
    """Every ``step``-th row from ``start`` up to but not with ``end``."""
    return df.where((F.col(pos) >= start) & (F.col(pos) < end) & ((F.col(pos) - start) % step == 0))


def masked(df: DataFrame, mask: Column) -> DataFrame:
    """The rows where the mask holds; NULL is no."""
    return df.where(F.coalesce(mask, F.lit(False)))


def united_maps(a: Column, b: Column) -> Column:
    """All keys of both maps. Raises where a key has different values."""
    differ = F.exists(F.map_keys(a), lambda k: F.map_contains_key(b, k) & ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))
    rest = F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k))
    return F.when(differ, F.raise_error(F.lit("maps differ in a key")).cast("map<string,bigint>")).otherwise(F.map_concat(a, rest))


def appended(df: DataFrame, group: str, metrics: str, order: str) -> DataFrame:
    """Per group and key of the map ``metrics``: ``values``, the list of its values in the order of the rows."""
    rows = df.select(group, F.col(order).alias("_o"), F.explode(metrics).alias("key", "value"))
    return rows.groupBy(group, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "value"))), lambda x: x["value"]).alias("values"))


def computed_once(df: DataFrame, key: str, source: str, compute) -> DataFrame:
    """Adds ``computed``, reckoned once per key from its row with the least ``source``, and looked up by all rows of the key."""
    once = df.groupBy(key).agg(F.min(source).alias("_first")).select(key, compute(F.col("_first")).alias("computed"))
    return df.join(once, key)


def rollout_joined(prompts: DataFrame, outputs: DataFrame, key: str, n: str, slot: str = "slot") -> DataFrame:
    """Each prompt repeated ``n`` (a column) times, one per ``slot`` from 0, with the output of its key and slot; every output stays,
    also one without a prompt."""
    repeats = prompts.where(F.col(n) > 0).withColumn(slot, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))).drop(n)
    return repeats.join(outputs, [key, slot], "full")


def restarted(df: DataFrame, rows: int, draws: int, pos: str = "pos") -> DataFrame:
    """What an iterator over ``rows`` rows gives in ``draws`` draws, beginning anew in the same order when it is through: ``draw`` and
    ``epoch`` of each row."""
    times = F.floor((F.lit(draws - 1) - F.col(pos)) / max(1, rows)).cast("int")
    return df.where(F.col(pos) < draws).withColumn("epoch", F.explode(F.sequence(F.lit(0), times))).withColumn("draw", (F.col("epoch").cast("long") * rows + F.col(pos)).cast("long"))


def first_per(df: DataFrame, group: str, key: str) -> DataFrame:
    """One row of each group, that of the least key: what is shown once, whoever comes first."""
    return df.groupBy(group).agg(F.min(F.struct(key, *[c for c in df.columns if c not in (group, key)])).alias("_r")).select(group, "_r.*")


def sorted_predictions(df: DataFrame, group: str, frame: str, fields: list[str]) -> DataFrame:
    """Per group its predictions as one array, by frame, ties by the other fields."""
    return df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(frame, *fields))).alias("predictions"))
