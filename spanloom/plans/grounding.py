"""A grounding view of the event stream: one row per event, as a response with a ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table

SHAPES = {
    "click": lambda p, q: F.concat(F.lit("<answer> "), p, F.lit(" to "), q, F.lit(" </answer>")),
    "view": lambda p, q: F.concat(F.lit("The event happens in "), p, F.lit(" - "), q, F.lit(" seconds")),
    "signup": lambda p, q: F.concat(F.lit("<answer>\n"), p, F.lit(" and "), q, F.lit("\n</answer>")),
    "purchase": lambda p, q: F.concat(F.lit("from 00:"), F.lpad((p.cast("long") % 60).cast("string"), 2, "0"), F.lit(" to 01:"), F.lpad((q.cast("long") % 60).cast("string"), 2, "0")),
}


def grounding(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    v = F.floor("value").cast("long")
    e = e.select(
        "event_id", "user_id", "event_type", k.alias("k"), F.expr("event_id div 8").alias("uid"), (F.col("event_id") % 8).alias("slot"),
        (30 + F.col("user_id") % 121).cast("double").alias("duration"),
        ((F.col("event_id") * 7) % 50).cast("double").alias("gt_s"), ((F.col("event_id") * 7) % 50 + F.col("event_id") % 29).cast("double").alias("gt_e"),
        (v % 60).alias("p_s"), (v % 60 + k % 15).alias("p_e"),
        (((F.col("event_id") * 37) % 101) / 100.0).alias("difficulty"), F.col("value").alias("score"),
    ).withColumn("is_gt", F.col("slot") == 7)
    p, q = F.col("p_s").cast("string"), F.col("p_e").cast("string")
    said = F.lit("cannot tell")
    for name, shape in SHAPES.items():
        said = F.when(F.col("event_type") == name, shape(p, q)).otherwise(said)
    truth = F.concat(F.col("gt_s").cast("long").cast("string"), F.lit(" to "), F.col("gt_e").cast("long").cast("string"))
    return e.withColumn("ground_truth", truth).withColumn("response", said)


SQL = """
grounding0 AS (
  SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id // 8 AS uid, event_id % 8 AS slot,
    CAST(30 + user_id % 121 AS DOUBLE) AS duration, CAST((event_id * 7) % 50 AS DOUBLE) AS gt_s, CAST((event_id * 7) % 50 + event_id % 29 AS DOUBLE) AS gt_e,
    CAST(floor(value) AS BIGINT) % 60 AS p_s, ((event_id * 37) % 101) / 100.0::DOUBLE AS difficulty, value AS score, event_id % 8 = 7 AS is_gt
  FROM events),
grounding1 AS (SELECT *, p_s + k % 15 AS p_e, CAST(CAST(gt_s AS BIGINT) AS VARCHAR) || ' to ' || CAST(CAST(gt_e AS BIGINT) AS VARCHAR) AS ground_truth FROM grounding0),
grounding AS (SELECT *, CASE event_type
    WHEN 'click' THEN '<answer> ' || p_s || ' to ' || p_e || ' </answer>'
    WHEN 'view' THEN 'The event happens in ' || p_s || ' - ' || p_e || ' seconds'
    WHEN 'signup' THEN '<answer>' || chr(10) || p_s || ' and ' || p_e || chr(10) || '</answer>'
    WHEN 'purchase' THEN 'from 00:' || lpad(CAST(p_s % 60 AS VARCHAR), 2, '0') || ' to 01:' || lpad(CAST(p_e % 60 AS VARCHAR), 2, '0')
    ELSE 'cannot tell' END AS response FROM grounding1)
"""
