"""Listings of checkpoints and of tensor names. Candidates are reported, nothing is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retained(steps: DataFrame, current: int, best: int, limit: int, step: str = "step") -> DataFrame:
    """``step``, ``keep`` of the steps before ``current``: the best, and the newest up to ``limit - 1`` in all.

    Without a positive limit all are kept. A run has as many steps as checkpoints were written, so one window holds them.
    """
    older = steps.select(F.col(step).alias("step")).distinct().where(F.col("step") < current)
    if limit <= 0:
        return older.withColumn("keep", F.lit(True))
    has_best = older.where(F.col("step") == best).limit(1).count()
    places = max(limit - 1 - has_best, 0)
    rank = F.row_number().over(Window.orderBy((F.col("step") == best).asc(), F.col("step").desc()))
    return older.withColumn("keep", (F.col("step") == best) | (rank <= places))


def step_of(folder: Column) -> Column:
    """The step of a folder ``global_step_N``, NULL for other names, also for such with more behind the number."""
    return F.regexp_extract(folder, r"^global_step_(\d+)$", 1).try_cast("long")


def thinned(files: DataFrame, keep_full: int, folder: str = "folder", name: str = "name") -> DataFrame:
    """Files of other steps than ``keep_full`` that hold no weights: optimizer and extra states and data loaders."""
    state = F.col(name).rlike(r"^(?:optim|extra_state)_.*\.pt$") | (F.col(name) == "dataloader.pt")
    return files.withColumn("step", step_of(F.col(folder))).where(F.col("step").isNotNull() & (F.col("step") != keep_full) & state)


def renamed_keys(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule whose prefix the name has replaces it."""
    out = None
    for old, new in rules:
        out = (F if out is None else out).when(name.startswith(old), F.concat(F.lit(new), F.substring(name, len(old) + 1, 10_000)))
    return name if out is None else out.otherwise(name)


def pattern_renamed(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The first pattern that is found replaces; groups in the replacement are taken out."""
    import re

    out = None
    for pattern, new in rules:
        plain = re.sub(r"\(.*\)", "", new.lstrip("^"))
        out = (F if out is None else out).when(name.rlike(pattern), F.regexp_replace(name, pattern, plain))
    return name if out is None else out.otherwise(name)


def listed_keys(index_json: Column) -> Column:
    """The tensor names of an index file's ``weight_map``."""
    return F.map_keys(F.from_json(F.get_json_object(index_json, "$.weight_map"), "map<string,string>"))
