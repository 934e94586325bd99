"""Positions of media tokens, prepared files, micro-batch maps and other small queries."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import dispatch as D
from ..storage import table
from .groupwise import SEQ, sequences

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


FULL = "CASE WHEN starts_with(preprocessed_video, '/') THEN preprocessed_video ELSE '/art/' || preprocessed_video END"


@query(f"WITH l AS (SELECT DISTINCT {FULL} AS file FROM records WHERE row_id % 3 > 0 AND preprocessed_video IS NOT NULL) SELECT row_id, file AS artifact FROM records LEFT JOIN l ON {FULL} = file")
def s13_prepared(spark, d):
    r = table(spark, d, "records").select("row_id", "preprocessed_video")
    listing = table(spark, d, "records").where("row_id % 3 > 0").select(F.expr(FULL.replace("starts_with", "startswith")).alias("file"))
    return D.prepared_source(r, listing, "preprocessed_video", "/art", "optional").select("row_id", "artifact")


@query("SELECT DISTINCT user_id, event_id % 400 AS frame FROM events WHERE event_id % 400 IN (SELECT i * 7 FROM range(0, 58) t(i))")
def s11_frames(spark, d):
    """The frames of a video that are asked for; decoding is not part of the engine."""
    wanted = spark.range(58).select((F.col("id") * 7).alias("frame"))
    return table(spark, d, "events").select("user_id", (F.col("event_id") % 400).alias("frame")).distinct().join(wanted, "frame", "left_semi").select("user_id", "frame")


@query("SELECT batch, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most FROM (SELECT doc_id // 128 AS batch, doc_id % 8 AS part, 1 AS n FROM documents) q GROUP BY 1")
def l3_cover(spark, d):
    """Every item of a batch is in exactly one part."""
    from ..operators.balance import balanced
    docs = table(spark, d, "documents").select(F.expr("doc_id div 128").alias("batch"), "doc_id", F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))
    per = balanced(docs, "batch", "doc_id", "n_chars", 8).groupBy("batch", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("batch").agg(F.min("n").alias("least"), F.max("n").alias("most"))


@query(f"""WITH {SEQ}, g AS (SELECT uid, CAST(uid % 4 AS BIGINT) AS n, uid % 3 AS kind FROM tok WHERE slot = 0), p AS (SELECT uid, i, n, kind, i - n AS j FROM g, range(0, 10) r(i))
SELECT uid, i AS pos, CASE WHEN kind = 0 THEN CASE WHEN j < 0 THEN i WHEN j < 4 THEN n ELSE i - 2 END WHEN kind = 1 THEN CASE WHEN j IN (0, 1) THEN n WHEN j IN (3, 4) THEN n + 3 ELSE i END ELSE CASE WHEN j BETWEEN 0 AND 3 THEN n + 3 * (j // 2) ELSE i END END AS t,
CASE WHEN kind = 0 THEN CASE WHEN j < 0 THEN i WHEN j < 4 THEN n + j // 2 ELSE i - 2 END WHEN kind = 1 THEN CASE WHEN j IN (0, 1) THEN n WHEN j IN (3, 4) THEN n + 3 ELSE i END ELSE CASE WHEN j BETWEEN 0 AND 3 THEN n ELSE i END END AS h,
CASE WHEN kind = 0 THEN CASE WHEN j < 0 THEN i WHEN j < 4 THEN n + j % 2 ELSE i - 2 END WHEN kind = 1 THEN i ELSE CASE WHEN j BETWEEN 0 AND 3 THEN n + j % 2 ELSE i END END AS w FROM p""")
def q5_media_positions(spark, d):
    """After ``uid % 4`` words: a picture of 2 x 2 cells, a video of two frames of 1 x 2 cells with a word between them, or one whose time
    counts in steps of 3."""
    u = F.col("uid")
    long = lambda *x: F.array(*[F.lit(i).cast("long") for i in x])
    words = lambda n: F.array_repeat(F.lit(1).cast("long"), n)
    n = (u % 4).cast("int")
    media = F.when(u % 3 == 0, long(9, 9, 9, 9)).when(u % 3 == 1, long(8, 8, 1, 8, 8)).otherwise(long(8, 8, 8, 8))
    tokens = F.concat(words(n), media, words(10 - n - F.size(media)))
    grids = F.array(F.when(u % 3 == 0, long(1, 4, 4, 0)).otherwise(long(2, 2, 4, 1)))
    rows = sequences(spark, d).select("uid", tokens.alias("tokens"), grids.alias("grids"))
    plain, scaled = S.media_position_udf(9, 8, 2), S.media_position_udf(9, 8, 2, 3.0)
    both = rows.where("uid % 3 < 2").select("uid", plain("tokens", "grids").alias("p")).unionByName(rows.where("uid % 3 = 2").select("uid", scaled("tokens", "grids").alias("p")))
    return both.select("uid", F.posexplode("p").alias("pos", "x")).select("uid", F.col("pos").cast("long").alias("pos"), "x.t", "x.h", "x.w")


@query("SELECT doc_id // 128 AS batch, row_number() OVER (PARTITION BY doc_id // 128 ORDER BY doc_id) - 1 AS pos, CASE WHEN text IS NULL THEN 0.0 ELSE CAST(coalesce(n_chars, 0) AS DOUBLE) * 2 END AS value FROM documents")
def l7_micro_batch_map(spark, d):
    """A stand-in for a model's pass over micro-batches of even work, masked, in the order of the batch again."""
    docs = table(spark, d, "documents").select(F.expr("doc_id div 128").alias("batch"), "doc_id", F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"), F.col("text").isNotNull().cast("double").alias("mask"))
    made = D.mapped_in_micro_batches(docs, "batch", "doc_id", "n_chars", 4, lambda p: p["n_chars"] * 2.0, "value", "mask")
    return made.select("batch", "pos", "value")


@query("SELECT form, i AS row, j AS col, CAST((i * 5 + j) AS DOUBLE) / 300 AS share FROM range(0, 5) a(i), range(0, 5) b(j), (VALUES ('keys'), ('rows'), ('json'), ('file')) AS f(form) WHERE i * 5 + j > 0")
def o5_joint_targets(spark, d):
    """Joint targets by keys, as rows, as JSON text and in a file."""
    rows = [[float(i * 5 + j) for j in range(5)] for i in range(5)]
    keys = {f"{i}{'|' if i % 2 else ', '}{j}": rows[i][j] for i in range(5) for j in range(5)}
    out = None
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:  # a file of the driver's, as configurations are
        f.write(json.dumps(keys))
        f.flush()
        for form, given in (("keys", keys), ("rows", rows), ("json", json.dumps({str(i): r for i, r in enumerate(rows)})), ("file", f.name)):
            made = D.joint_targets(spark, given).select(F.lit(form).alias("form"), "row", "col", "share")
            out = made if out is None else out.unionByName(made)
    return out
