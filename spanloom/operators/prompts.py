"""Prompts, messages and the contract on videos that go with them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE_TYPES = ["inline", "preprocessed", "path"]
SOURCE_MODES = ["preprocessed_only", "prefer_preprocessed", "realtime_only"]


def built(rows: DataFrame, templates: DataFrame, frame: tuple[str, str] = ("", "\n")) -> DataFrame:
    """Adds ``prompt``: the frame around the problem, then the tail of its type; unknown types have no tail.

    ``templates`` (problem_type, tail) is configuration, one row per type. Options follow a multiple choice problem;
    ``segmentation`` is split by data type.
    """
    kind = F.when(F.col("problem_type") == "segmentation", F.when(F.lower(F.trim("data_type")) == "video", "segmentation_video").otherwise("segmentation_image")).otherwise(F.col("problem_type"))
    asked = F.when((F.col("problem_type") == "multiple choice") & (F.size("options") > 0), F.concat("problem", F.lit("\nOptions:\n"), F.array_join("options", "\n"))).otherwise(F.col("problem"))
    tails = templates.select(F.col("problem_type").alias("_kind"), F.col("tail").alias("_tail"))
    out = rows.withColumn("_kind", kind).join(F.broadcast(tails), "_kind", "left")
    return out.withColumn("prompt", F.concat(F.lit(frame[0]), asked, F.lit(frame[1]), F.coalesce("_tail", F.lit("")))).drop("_kind", "_tail")


def evaluation_setup(model: Column, thinking: Column, bare: Column, own: list[str], families: list[tuple[str, int, list[str]]]) -> Column:
    """Which prompt, rate and family go with a model's name.

    Models whose name has one of ``own`` in it take the plain prompt. ``families``: (name, rate, parts of model names); the
    first that fits counts, the first of the list where none does.
    """
    name = F.lower(model)

    def has(parts: list[str]) -> Column:
        out = F.lit(False)
        for part in parts:
            out = out | name.contains(part)
        return out

    prompt = F.when(has(own), "plain").when(thinking, "thinking").when(bare, "bare").otherwise("plain")
    family, rate = F.lit(families[0][0]), F.lit(families[0][1])
    for label, n, parts in reversed(families):
        family, rate = F.when(has(parts), label).otherwise(family), F.when(has(parts), n).otherwise(rate)
    return F.struct(prompt.alias("prompt"), rate.alias("rate"), family.alias("family"))


def content_parts(text: Column, marker: str, kind: str) -> Column:
    """A text cut at its media markers: a marker before each part but the first, empty texts left out."""
    parts = F.split(text, marker)
    each = F.transform(parts, lambda p, i: F.concat(
        F.when(i > 0, F.array(F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>")),
        F.when(p != "", F.array(F.struct(F.lit("text").alias("type"), p.alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>"))))
    return F.flatten(each)


def video_source(mode: Column, paths: Column, prepared: Column, frames: Column) -> Column:
    """The contract of a video: inline frames before anything, then by mode prepared files or paths. Raises where a mode
    needs a prepared file that is not there."""
    ready = prepared.isNotNull()
    kind = (
        F.when(frames > 0, "inline").when((mode == "preprocessed_only") & ~ready, F.raise_error(F.lit("no prepared video")).cast("string"))
        .when(mode.isin("preprocessed_only", "prefer_preprocessed") & ready, "preprocessed").when(mode.isin(SOURCE_MODES), "path").otherwise(F.raise_error(F.lit("unknown mode")).cast("string"))
    )
    return F.struct(kind.alias("source_type"), F.when((frames > 0) | ~(mode.isin("preprocessed_only", "prefer_preprocessed") & ready), paths).otherwise(F.array(prepared)).alias("paths"))


def source_mode(mode: Column, prepared: Column) -> Column:
    """The mode, by default by whether prepared videos are used."""
    return F.when(mode.isNull() | (mode == ""), F.when(prepared, "prefer_preprocessed").otherwise("realtime_only")).when(mode.isin(SOURCE_MODES), mode).otherwise(F.raise_error(F.lit("unknown mode")).cast("string"))


def contract_fault(images: Column, kind: Column, paths: Column, frames: Column, metadata: Column) -> Column:
    """What is wrong with a sample's media, NULL where nothing is. Counts may be NULL for what is absent."""
    has_images, has_video = images.isNotNull(), kind.isNotNull() | paths.isNotNull()
    return (
        F.when(has_images & has_video, "both images and video").when(has_images & (images == 0), "no images")
        .when(kind.isNotNull() & ~kind.isin(SOURCE_TYPES), "unknown source").when(has_video & (F.coalesce(F.size(paths), F.lit(0)) <= 0), "no paths")
        .when((kind == "inline") & (F.coalesce(frames, F.lit(0)) == 0), "no frames").when((kind == "inline") & ~F.coalesce(frames == metadata, F.lit(False)), "frames and metadata differ")
    )


def resized(w: Column, h: Column, least: int, most: int) -> Column:
    """Sides of an image shrunk to at most, then grown to at least so many pixels, both cut to whole numbers."""
    def fit(w: Column, h: Column, pixels: int, when: Column) -> tuple[Column, Column]:
        f = F.sqrt(F.lit(float(pixels)) / (w * h))
        return F.when(when, F.floor(w * f)).otherwise(w), F.when(when, F.floor(h * f)).otherwise(h)

    w1, h1 = fit(w, h, most, w * h > most)
    w2, h2 = fit(w1, h1, least, w1 * h1 < least)
    return F.struct(w2.cast("long").alias("w"), h2.cast("long").alias("h"))


def fallback_metadata(frames: Column, fps: Column) -> Column:
    """What is known of a decoded video without its own metadata."""
    return F.struct(fps.alias("fps"), frames.alias("total_num_frames"), F.when(fps > 0, frames / fps).alias("duration"))


def rooted(path: Column, root: str) -> Column:
    """A relative path under ``root``, an absolute one as it is."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def passed_through(problem: Column, content: Column) -> Column:
    """The template that states the problem, or else the content, without blanks around it. Raises without either."""
    return F.trim(F.coalesce(problem, content, F.raise_error(F.lit("neither problem nor content")).cast("string")), F.lit(" \t\n\r"))


def filled(template: str, rows: DataFrame) -> Column:
    """A template text with ``{name}`` for the row's fields, NULL as nothing. Raises for names that are no columns."""
    out = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 and part not in rows.columns:
            raise ValueError(f"no field {part!r}")
        out.append(F.coalesce(F.col(part).cast("string"), F.lit("")) if i % 2 else F.lit(part))
    return F.concat(*out)


def within_length(df: DataFrame, text: str, most: int, tokens: Callable[[Column], Column], name: str = "kept") -> DataFrame:
    """Adds whether a prompt has at most ``most`` tokens; ``tokens`` counts those of a column of texts (any tokenizer, as an
    expression or a pandas function). A NULL prompt has none."""
    return df.withColumn(name, F.coalesce(tokens(F.col(text)), F.lit(0)) <= most)


def reward_inputs(df: DataFrame, optional: list[str]) -> Column:
    """What a reward function is given: the response, its length (0 where unknown) and the optional fields, NULL where the table
    lacks them."""
    fields = [F.col(c).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in optional]
    return F.struct("response", F.coalesce("response_length", F.lit(0)).alias("response_length"), *fields)
