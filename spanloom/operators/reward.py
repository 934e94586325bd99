"""Scores of responses against ground truths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import parsing as P

# Fixed value: a pair of numbers as an answer states it.
PAIR = r"\d+\.?\d*\s*(?:to|and|-)\s*\d+\.?\d*"


def span_format(response: Column, strict: bool = False) -> Column:
    """1 where the first answer block states a pair; strict: one block, at the end, on one line."""
    block = F.regexp_extract(response, P.BLOCK_ANY_LINES, 1)
    good = response.rlike(P.BLOCK_ANY_LINES) & block.rlike(PAIR)
    if strict:
        alone = F.size(P.found(response, P.BLOCK_ANY_LINES, 1)) == 1
        good = good & alone & F.regexp_replace(response, r"\s+$", "").endswith("</answer>") & ~block.rlike(r"[\n\r]")
    return F.when(good, 1.0).otherwise(0.0)


def box_format(response: Column, strict: bool = False) -> Column:
    """1 where the last answer block holds a box; strict as in :func:`span_format`."""
    good = P.box(P.last_answer(response)).isNotNull()
    if strict:
        alone = F.size(P.found(response, P.BLOCK_ANY_LINES, 1)) == 1
        good = good & alone & F.regexp_replace(response, r"\s+$", "").endswith("</answer>") & ~F.regexp_extract(response, P.BLOCK_ANY_LINES, 1).rlike(r"[\n\r]")
    return F.when(good, 1.0).otherwise(0.0)


def span_reward(response: Column, truth: Column) -> Column:
    a, b = P.rewarded_span(response), P.rewarded_span(truth)
    return F.coalesce(G.span_iou(a["start"], a["end"], b["start"], b["end"]), F.lit(0.0))


def box_reward(response: Column, truth: Column) -> Column:
    return F.coalesce(G.box_iou(P.box(P.last_answer(response)), P.box(truth)), F.lit(0.0))


def scored(df: DataFrame, response: str = "response", truth: str = "ground_truth", format_weight: float = 0.1, shaping: bool = False) -> DataFrame:
    """Adds ``task``, ``iou_raw``, ``iou``, ``format``, ``overall``: a box where the truth has four numbers, else a span,
    else all zeros. NULL texts read as empty."""
    r, t = F.coalesce(response, F.lit("")), F.coalesce(truth, F.lit(""))
    made = df.withColumn("_t", F.struct(P.box(t).alias("box"), P.rewarded_span(t).alias("span")))
    made = made.withColumn("task", F.when(F.col("_t.box").isNotNull(), "box").when(F.col("_t.span").isNotNull(), "span").otherwise("unknown"))
    is_box, is_span = F.col("task") == "box", F.col("task") == "span"
    made = made.withColumn("_r", F.struct(F.when(is_box, P.box(P.last_answer(r))).alias("box"), F.when(is_span, P.rewarded_span(r)).alias("span")))
    pred, gt = F.col("_r.span"), F.col("_t.span")
    spans = F.coalesce(G.span_iou(pred["start"], pred["end"], gt["start"], gt["end"]), F.lit(0.0))
    boxes = F.coalesce(G.box_iou(F.col("_r.box"), F.col("_t.box")), F.lit(0.0))
    made = made.withColumn("iou_raw", F.when(is_box, boxes).when(is_span, spans).otherwise(F.lit(0.0)))
    made = made.withColumn("format", F.when(is_box, F.col("_r.box").isNotNull().cast("double")).when(is_span, span_format(r)).otherwise(F.lit(0.0)))
    shaped = F.when(is_box | is_span, G.shaped(F.col("iou_raw"))).otherwise(F.lit(0.0))
    made = made.withColumn("iou", shaped if shaping else F.col("iou_raw"))
    return made.withColumn("overall", F.col("iou") + format_weight * F.col("format")).drop("_t", "_r")


def controlled(df: DataFrame, score: str, flag: str, scale: float = 1.0, cap: float | None = None) -> DataFrame:
    """Scores of reference rows scaled, then capped; others as they are."""
    value = F.col(score) * scale
    return df.withColumn("controlled", F.when(F.col(flag), value if cap is None else F.least(value, F.lit(cap))).otherwise(F.col(score)))


def at_last_token(score: Column, length: Column) -> Column:
    """Zeros up to the last of ``length`` tokens, which has the score."""
    return F.when(length > 0, F.transform(F.sequence(F.lit(1), length), lambda i: F.when(i == length, score).otherwise(F.lit(0.0)))).otherwise(F.array().cast("array<double>"))
