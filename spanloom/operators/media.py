"""Where the media of a sample come from, and what is known of them. Decoding is not part of the engine: frames are
counted in a listing that decoders or earlier steps have written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rates that are assumed where none is known, of a video file and of prepared frames.
VIDEO_FPS, ARTIFACT_FPS = 25.0, 2.0
# How files of an image format begin, in hexadecimal.
IMAGE_HEADS = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "bmp": "424D"}

METADATA = "struct<fps: double, total: int, indices: array<int>>"


def image_source(path: Column, data: Column) -> Column:
    """``kind`` (``bytes`` before ``path``, NULL without either), ``format`` by the first bytes, and the sides that a PNG or GIF states
    in its header."""
    head = F.hex(F.substring(data, 1, 8))
    kind = F.when(F.length(data) > 0, "bytes").when(F.length(F.trim(path)) > 0, "path")
    form = F.lit(None).cast("string")
    for name, start in IMAGE_HEADS.items():
        form = F.when(head.startswith(start), name).otherwise(form)

    def number(*at: int) -> Column:
        """Of the bytes at these places, most significant first."""
        return F.conv(F.concat(*[F.hex(F.substring(data, i, 1)) for i in at]), 16, 10).cast("int")

    sides = F.when(form == "png", F.array(number(17, 18, 19, 20), number(21, 22, 23, 24))).when(form == "gif", F.array(number(8, 7), number(10, 9)))
    return F.struct(kind.alias("kind"), form.alias("format"), sides[0].alias("w"), sides[1].alias("h"))


def video_metadata(frames: Column, fps: Column, w: Column, h: Column) -> Column:
    """``frames``, ``fps`` (``VIDEO_FPS`` where it is NULL, NaN or not positive), ``w``, ``h`` and ``duration`` in seconds."""
    rate = F.when((fps > 0) & ~F.isnan(fps), fps).otherwise(F.lit(VIDEO_FPS))
    return F.struct(frames.alias("frames"), rate.alias("fps"), w.alias("w"), h.alias("h"), (frames / rate).alias("duration"))


def artifact_metadata(metadata: Column, frames: Column) -> Column:
    """The metadata as they are, or those of all frames at ``ARTIFACT_FPS``."""
    plain = F.struct(F.lit(ARTIFACT_FPS).alias("fps"), frames.cast("int").alias("total"), F.when(frames > 0, F.sequence(F.lit(0), frames.cast("int") - 1)).otherwise(F.array().cast("array<int>")).alias("indices"))
    return F.coalesce(metadata, F.when(frames.isNotNull(), plain))


def artifact_record(path: Column, frames: Column, fps: Column, version: str) -> Column:
    """What is written beside prepared frames."""
    return F.struct(path.alias("path"), frames.alias("frames"), artifact_metadata(F.lit(None).cast(METADATA), frames).alias("metadata"), fps.alias("sample_fps"), F.lit(version).alias("version"))


def resolved(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """``key``, ``at``, ``origin``, ``path``, ``frames``, ``metadata``: the videos of each sample in their order.

    A sample states its videos in the first of these columns that is not NULL: ``video`` (a struct of ``source_type``, ``paths``,
    ``frames`` and ``metadatas``), ``tensors`` with ``video_metadatas``, ``preprocessed_video_path``, ``videos``. ``files`` lists
    ``path``, ``frames`` and ``metadata`` of what can be read. Raises for an unknown source type, inline videos without frames or metadata, and
    prepared or original files that are not listed. Samples without videos have no rows.
    """
    entry = "array<struct<origin: string, path: string, frames: int, metadata: " + METADATA + ">>"
    none, v = F.lit(None), F.col("video")

    def of_paths(paths: Column, origin: str) -> Column:
        return F.transform(paths, lambda p: F.struct(F.lit(origin).alias("origin"), p.alias("path"), none.cast("int").alias("frames"), none.cast(METADATA).alias("metadata")))

    def of_frames(frames: Column, metadatas: Column, origin: str, fill: bool) -> Column:
        n = F.least(F.size(frames), F.size(metadatas))
        both = F.arrays_zip(F.slice(frames, F.lit(1), n).alias("f"), F.slice(metadatas, F.lit(1), n).alias("m"))
        return F.transform(both, lambda x: F.struct(F.lit(origin).alias("origin"), none.cast("string").alias("path"), x["f"].alias("frames"), (artifact_metadata(x["m"], x["f"]) if fill else x["m"]).alias("metadata")))

    kind = v["source_type"]
    absent = F.transform("tensors", lambda _: none.cast(METADATA))
    entries = (
        F.when((kind == "inline") & (v["frames"].isNull() | v["metadatas"].isNull()), F.raise_error(F.lit("inline videos need frames and metadata")).cast(entry))
        .when(kind == "inline", of_frames(v["frames"], v["metadatas"], "inline", True))
        .when(kind.isin("preprocessed", "path"), F.when(kind == "path", of_paths(v["paths"], "path")).otherwise(of_paths(v["paths"], "preprocessed")))
        .when(kind.isNotNull(), F.raise_error(F.concat(F.lit("unknown source type "), kind)).cast(entry))
        .when(F.col("tensors").isNotNull(), of_frames(F.col("tensors"), F.coalesce("video_metadatas", absent), "given", False))
        .when(F.col("preprocessed_video_path").isNotNull(), of_paths(F.array("preprocessed_video_path"), "preprocessed"))
        .when(F.col("videos").isNotNull(), of_paths(F.col("videos"), "path"))
    )
    one = rows.select(key, F.posexplode(entries).alias("at", "x")).select(key, "at", "x.*")
    listed = files.select(F.col("path").alias("_path"), F.col("frames").alias("_frames"), F.col("metadata").alias("_metadata"))
    met = one.join(listed, F.col("path") == F.col("_path"), "left")
    lost = F.col("path").isNotNull() & F.col("_path").isNull()
    frames = F.when(lost, F.raise_error(F.concat(F.lit("no such file: "), F.col("path"))).cast("int")).otherwise(F.coalesce("frames", "_frames"))
    own = F.when(F.col("origin").isin("given", "inline"), F.col("metadata")).otherwise(artifact_metadata(F.col("_metadata"), F.col("_frames")))
    return met.select(key, "at", "origin", "path", frames.alias("frames"), own.alias("metadata"))


def contents(text: Column, images: Column, videos: Column) -> Column:
    """A prompt as an array of (type, text): cut at ``<image>`` where there are images, at ``<video>`` where there are videos, else one
    text. A marker stands before each part but the first, empty texts are left out, and a sample with both raises."""
    from .prompts import content_parts

    has_images, has_videos = F.coalesce(F.size(images), F.lit(0)) > 0, F.coalesce(F.size(videos), F.lit(0)) > 0
    whole = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    return (
        F.when(has_images & has_videos, F.raise_error(F.lit("images and videos in one sample")).cast("array<struct<type:string,text:string>>"))
        .when(has_images, content_parts(text, "<image>", "image")).when(has_videos, content_parts(text, "<video>", "video")).otherwise(whole)
    )
