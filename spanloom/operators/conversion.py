"""Raw grounding rows to trainer records: fallback durations, filters with an account of what they skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P


def duration_index(sidecar: DataFrame) -> DataFrame:
    """``name``, ``duration``: the last line of each file name; lines without a path or a number are skipped."""
    path = F.coalesce("video_path", F.get("videos", F.lit(0)))
    lines = sidecar.select(P.basename(path).alias("name"), "line_no", F.col("duration")).where("name IS NOT NULL AND duration IS NOT NULL")
    return lines.groupBy("name").agg(F.max_by("duration", "line_no").alias("duration"))


def with_fallback_duration(rows: DataFrame, index: DataFrame, path: Column) -> DataFrame:
    """``duration`` from the index where the row has none. The index has one row per video, so the row count stays."""
    other = index.select(F.col("name").alias("_name"), F.col("duration").alias("_duration"))
    return rows.withColumn("_name", P.basename(path)).join(other, "_name", "left").withColumn("duration", F.coalesce("duration", "_duration")).drop("_name", "_duration")


def _outside(value: Column, lo: float | None, hi: float | None) -> Column:
    """Whether a bound is set that the value is not within; NULL is within none."""
    out = F.lit(False)
    if lo is not None:
        out = out | F.coalesce(~(value >= lo), F.lit(True))
    if hi is not None:
        out = out | F.coalesce(~(value <= hi), F.lit(True))
    return out


def reasoned(rows: DataFrame, difficulty=(None, None), duration=(None, None), length=(None, None), coverage=(None, None), truth: str = "answer") -> DataFrame:
    """Adds ``gt_len`` and ``reason``: the first filter that the row fails (difficulty, duration, gt_len, coverage), else NULL."""
    s = P.first_numbers(F.col(truth))
    gt = F.when(s.isNotNull(), F.greatest(F.lit(0.0), s["end"] - s["start"]))
    rows = rows.withColumn("gt_len", gt)
    share = F.when(F.col("duration") > 0, F.col("gt_len") / F.col("duration"))
    reason = (
        F.when(_outside(F.col("difficulty"), *difficulty), "difficulty").when(_outside(F.col("duration"), *duration), "duration")
        .when(_outside(F.col("gt_len"), *length), "gt_len").when(_outside(share, *coverage), "coverage")
    )
    return rows.withColumn("coverage", share).withColumn("reason", reason)


def trainer_records(rows: DataFrame, message: str = "problem", truth: str = "answer", video: Column | None = None) -> DataFrame:
    """The trainer's columns with their constants; optional ones are NULL, which JSON leaves out."""
    s = P.first_numbers(F.col(truth))
    answer = F.when(s.isNotNull(), F.concat(F.lit("<answer> "), s["start"].cast("string"), F.lit(" to "), s["end"].cast("string"), F.lit(" </answer>"))).otherwise(F.col(truth))
    return rows.select(
        P.question(F.col(message)).alias("problem"), answer.alias("answer"), F.lit("temporal grounding").alias("problem_type"), F.lit("video").alias("data_type"),
        F.array(video if video is not None else F.get("videos", F.lit(0))).alias("videos"), F.lit(False).alias("has_offline_trajectory"), F.lit("").alias("offline_output"), "difficulty", "duration", "gt_len",
    )
