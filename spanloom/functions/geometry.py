"""Intervals, boxes and crops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def span_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two spans over their hull; NULL where an end is NULL. Inverted spans overlap nothing."""
    whole = F.greatest(a1, b1) - F.least(a0, b0)
    part = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.when(a0.isNull() | a1.isNull() | b0.isNull() | b1.isNull(), F.lit(None).cast("double")).otherwise(share(part, whole))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); negative sides count as 0."""
    zero = F.lit(0.0)
    side = lambda lo, hi: F.greatest(zero, hi - lo)
    inter = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    area = lambda x: side(x[0], x[2]) * side(x[1], x[3])
    return F.when(a.isNotNull() & b.isNotNull(), share(inter, area(a) + area(b) - inter))


def crop_floor(w: Column, h: Column, tw: Column, th: Column) -> Column:
    """The largest crop of a ratio that fits: width rounded down, height following from it, unrounded."""
    cw = F.greatest(F.lit(1.0), F.when(w / h >= tw / th, F.least(F.floor(h * tw / th).cast("double"), w)).otherwise(w))
    out = F.struct(cw.alias("w"), (cw * th / tw).alias("h"))
    return F.when((tw <= 0) | (th <= 0) | (w <= 0) | (h <= 0), F.struct(w.cast("double").alias("w"), h.cast("double").alias("h"))).otherwise(out)


def crop_round(w: Column, h: Column, tw: Column, th: Column) -> Column:
    """The same with both sides rounded, halves to even."""
    wide = w / h >= tw / th
    cw = F.when(wide, F.least(F.rint(h * tw / th), w)).otherwise(w)
    ch = F.when(wide, h).otherwise(F.least(F.rint(w / (tw / th)), h))
    one = F.lit(1.0)
    return F.struct(F.greatest(one, cw).alias("w"), F.greatest(one, ch).alias("h"))


def centred_box(cx: Column, cy: Column, w: Column, h: Column, cw: Column, ch: Column) -> Column:
    """The corner of a crop around a point given in shares, kept inside; x to the nearest even, y down."""
    x = F.rint(F.greatest(F.lit(0.0), F.least(cx * w - cw / 2, w - cw)))
    y = F.floor(F.greatest(F.lit(0.0), F.least(cy * h - ch / 2, h - ch))).cast("double")
    return F.struct(x.alias("x"), y.alias("y"))


def frames(start: Column, end: Column, fps: Column, n: Column) -> Column:
    """Seconds as frames within 0..n-1, in order; NULL for an empty stretch."""
    clamp = lambda f: F.greatest(F.lit(0), F.least(F.rint(f).cast("int"), (n - 1).cast("int")))
    a, b = clamp(F.least(start, end) * fps), clamp(F.greatest(start, end) * fps)
    return F.when(b > a, F.struct(a.alias("a"), b.alias("b")))


def shaped(iou: Column, threshold: float = 0.8, alpha: float = 1.0) -> Column:
    """A reward flat above the threshold and falling exponentially below it."""
    import math

    scale = math.exp(alpha) - 1
    low = F.lit(threshold) - (F.exp(alpha * (threshold - iou)) - 1) / scale if scale > 0 else F.greatest(F.lit(0.0), iou)
    return F.when(iou >= threshold, threshold + F.ln(iou - threshold + 1) * 0.01).otherwise(low)


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Between two coordinates, to the nearest whole number, halves to even."""
    return F.rint(a + (b - a) * t).cast("long")


def box_lerp(a: Column, b: Column, t: Column) -> Column:
    """Between two boxes of any number of coordinates."""
    return F.zip_with(a, b, lambda x, y: lerp(x, y, t))


def centre_crops(w: Column, h: Column, tw: Column, th: Column, frames: Column, stride: int) -> Column:
    """The largest centred crop of a ratio for every ``stride``-th of so many frames: frame, corner and sides."""
    c = crop_round(w, h, tw, th)
    return F.transform(F.sequence(F.lit(0).cast("long"), frames - 1, F.lit(stride).cast("long")), lambda f: F.struct(
        f.alias("frame"), F.rint((w - c["w"]) / 2).alias("x"), F.rint((h - c["h"]) / 2).alias("y"), c["w"].alias("w"), c["h"].alias("h")))


def predicted(span: Column, duration: Column) -> Column:
    """A parsed span in whole seconds, or one behind the video's end where there is none."""
    return F.struct(F.coalesce(F.rint(span["start"]), duration + 10).alias("start"), F.coalesce(F.rint(span["end"]), duration + 20).alias("end"))
