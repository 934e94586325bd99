"""Maps over micro-batches, checks of tables, and files met with their listing."""

from __future__ import annotations

import json
import pathlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .balance import balanced


def mapped_in_micro_batches(df: DataFrame, batch: str, key: str, length: str, parts: int, f: Callable[[pd.DataFrame], pd.Series], out: str, mask: str | None = None) -> DataFrame:
    """``f`` of each micro-batch of even work, by batch and key; a stand-in for a model's forward pass.

    ``pos`` is the place in the batch, in the order of the key, which the parts don't keep. With ``mask`` values are 0 where it is.
    """
    kind = dict(df.dtypes)
    place = F.row_number().over(Window.partitionBy(batch).orderBy(key)) - 1
    placed = df.join(balanced(df, batch, key, length, parts).select(key, "part"), key).withColumn("pos", place)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = f(pdf).astype("float64")
        return pd.DataFrame({batch: pdf[batch], key: pdf[key], "pos": pdf["pos"], out: values if mask is None else values.where(pdf[mask] != 0, 0.0)})

    return placed.groupBy(batch, "part").applyInPandas(run, f"{batch} {kind[batch]}, {key} {kind[key]}, pos int, {out} double")


def consistent(df: DataFrame, arrays: list[str]) -> Column:
    """Whether a row's arrays have one length."""
    first = F.size(arrays[0])
    out = F.lit(True)
    for a in arrays[1:]:
        out = out & (F.size(a) == first)
    return out


def prepared_source(rows: DataFrame, listing: DataFrame, path: str, root: str, mode: str) -> DataFrame:
    """Adds ``artifact``: the prepared file under ``root`` if the listing has it. ``mode`` ``required`` raises without."""
    full = F.when(F.col(path).startswith("/"), F.col(path)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    there = listing.select(F.col("file").alias("_file")).distinct()
    out = rows.withColumn("_full", full).join(there, F.col("_full") == F.col("_file"), "left")
    missing = F.raise_error(F.lit("no prepared file")).cast("string") if mode == "required" else F.lit(None).cast("string")
    return out.withColumn("artifact", F.when(F.col("_file").isNotNull(), F.col("_full")).otherwise(missing)).drop("_full", "_file")


def resolved_media(frames: Column, metadata: Column, images: Column) -> Column:
    """What a sample's media come out as: images before videos; raises where frames and metadata differ in number."""
    return F.when(images > 0, "image").when(frames == metadata, "video").when(frames.isNull(), "none").otherwise(F.raise_error(F.lit("metadata differ in number")).cast("string"))


def joint_targets(spark, given, size: int = 5) -> DataFrame | None:
    """``row``, ``col``, ``share``, scaled to one: of a list of rows, a dict keyed ``row|col`` or ``row,col``, a dict of rows, JSON text of
    one of these, or the path of a file with it. None and empty text give None; weights of 0 have no row. Raises for negative
    weights, none at all, and places outside ``size``."""
    if given is None or given == "":
        return None
    if isinstance(given, str):
        given = json.loads(given if given.lstrip()[:1] in ("[", "{") else pathlib.Path(given).read_text())
    cells: dict[tuple[int, int], float] = {}
    for k, v in given.items() if isinstance(given, dict) else enumerate(given):
        if isinstance(v, (list, tuple)):
            cells.update({(int(k), i): float(x) for i, x in enumerate(v)})
        else:
            a, b = re.split(r"\s*[|,]\s*", str(k))
            cells[int(a), int(b)] = float(v)
    total = sum(cells.values())
    if total <= 0 or min(cells.values()) < 0:
        raise ValueError("targets must be 0 or more and add up to more than 0")
    if any(not (0 <= a < size and 0 <= b < size) for a, b in cells):
        raise ValueError(f"targets outside {size} x {size}")
    return spark.createDataFrame([(a, b, v / total) for (a, b), v in sorted(cells.items()) if v], "row long, col long, share double")
