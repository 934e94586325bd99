"""Parsers and geometry against plain Python restatements, on generated texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import geometry as G
from spanloom.functions import parsing as P
from spanloom.operators import reward as R

PIECES = ["<answer>", "</answer>", " ", "\n", "3.5", "12", "7.", "00:12", "1:02:03", " to ", " and ", " - ", "-", "from", "(1,2),(30,44)", "x", ".", "SECONDS"]


def texts(n=3000):
    rng = random.Random(4)
    return [None, "", " "] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def rewarded(text):
    m = re.search("<answer>(.*?)</answer>", text, re.S)
    body = m[1] if m else text
    for link in ("(?:to|and)", "-"):
        hits = re.findall(rf"(\d+\.?\d*)\s*{link}\s*(\d+\.?\d*)", body, re.A)
        if hits:
            return float(hits[-1][0]), float(hits[-1][1])
    found = re.findall(r"\b(\d+\.?\d*)\b", body)
    return (float(found[0]), float(found[1])) if len(found) > 1 else None


def evaluated(text):
    text = text.lower()
    m = re.search(r"<answer>\s*([^\n]*?)\s*</answer>", text)
    body = m[1] if m else text
    clocks = re.findall(r"\b\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?\b", body)
    if len(clocks) > 1:
        sec = [sum(float(x) * 60**i for i, x in enumerate(reversed(c.split(":")))) for c in clocks]
        return sec[0], sec[1]
    for link in (r"\s*-\s*", r"\s+to\s+"):
        hits = re.findall(rf"(\d+\.?\d*){link}(\d+\.?\d*)", body)
        if hits:
            return float(hits[0][0]), float(hits[0][1])
    n = re.findall(r"\b(\d+\.\d+|\d+)\b", body)
    return (float(n[0]), float(n[1])) if len(n) > 1 else None


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    t = F.col("t")
    return df.select(t, P.rewarded_span(t).alias("r"), P.evaluated_span(t).alias("e"), P.first_numbers(t).alias("f"), P.box(t).alias("b"), R.span_format(t).alias("fmt"), R.span_format(t, True).alias("strict")).collect()


def test_rewarded(parsed):
    for row in parsed:
        want = rewarded(row.t) if row.t else None
        assert (tuple(row.r) if row.r else None) == want, row.t


def test_evaluated(parsed):
    for row in parsed:
        want = evaluated(row.t) if row.t else None
        assert (tuple(row.e) if row.e else None) == want, row.t


def test_first_numbers_and_box(parsed):
    for row in parsed:
        n = re.findall(r"\d+\.?\d*", row.t or "")
        assert (tuple(row.f) if row.f else None) == ((float(n[0]), float(n[1])) if len(n) > 1 else None)
        corners = re.search(r"\((\d+),(\d+)\),\((\d+),(\d+)\)", row.t or "")
        b = re.findall(r"\d+(?:\.\d+)?", row.t or "")
        want = [float(x) for x in corners.groups()] if corners else [float(x) for x in b[:4]] if len(b) > 3 else None
        assert row.b == want, row.t


def test_formats(parsed):
    for row in parsed:
        m = re.search("<answer>(.*?)</answer>", row.t or "", re.S)
        loose = bool(m and re.search(R.PAIR, m[1]))
        alone = len(re.findall("<answer>(.*?)</answer>", row.t or "", re.S)) == 1
        assert row.fmt == float(loose)
        assert row.strict == float(loose and alone and (row.t or "").rstrip().endswith("</answer>") and "\n" not in m[1])


def test_shaping_examples(spark):
    got = [r[0] for r in spark.createDataFrame([(0.8,), (1.0,), (0.0,)], "x double").select(G.shaped(F.col("x"))).collect()]
    assert [round(x, 4) for x in got] == [0.8, 0.8018, 0.0868]


def test_iou_is_symmetric_and_bounded(spark):
    rng = random.Random(1)
    spans = [tuple(rng.choice([0.0, 1.0, 2.5, 7.0]) for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame(spans, "a double, b double, c double, d double")
    a, b, c, d = (F.col(x) for x in "abcd")
    for x, y in df.select(G.span_iou(a, b, c, d), G.span_iou(c, d, a, b)).collect():
        assert x == y and 0 <= x <= 1


def test_half_to_even(spark):
    assert [r[0] for r in spark.createDataFrame([(0.125,), (2.5,), (1.005,)], "x double").select(P.cents(F.col("x"))).collect()] == ["0.12", "2.50", "1.00"]
