"""Reading and writing JSON, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reward as R
from ..sources import records as J
from ..storage import scratch, table
from ..streaming import running
from .grounding import SQL, grounding
from .sampling import ONE
from .scoring import SCORE_SQL

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


def _place(spark) -> str:
    return scratch(spark, "json")


@query("SELECT row_id, problem, answer, difficulty FROM records WHERE problem IS NOT NULL AND NOT (isnan(difficulty) OR isinf(difficulty)) OR difficulty IS NULL")
def s1_k1_json_lines(spark, d):
    rows = table(spark, d, "records").where("problem IS NOT NULL AND NOT (isnan(difficulty) OR abs(difficulty) = 'Infinity') OR difficulty IS NULL").select("row_id", "problem", "answer", "difficulty")
    J.write_lines(rows, path := _place(spark))
    return J.lines(spark, path, "row_id long, problem string, answer string, difficulty double")


@query("SELECT event_id, value FROM events WHERE event_id % 10 > 0")
def s2_tolerant_lines(spark, d):
    text = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "value")))
    table(spark, d, "events").select(text.alias("value")).write.text(path := _place(spark))
    return J.lines(spark, path, "event_id long, value double", tolerant=True)


@query("SELECT c_custkey, c_mktsegment FROM customer")
def s7_by_extension(spark, d):
    path = _place(spark) + ".jsonl"
    table(spark, d, "customer").select("c_custkey", "c_mktsegment").write.json(f"{path}/train")
    return J.by_extension(spark, f"{path}@train").select("c_custkey", "c_mktsegment")


@query("SELECT result_id, video, CASE WHEN error IS NULL THEN len(pred_span) END AS n, error FROM (SELECT DISTINCT result_id, video, pred_span, error FROM eval_results) q")
def s17_y4_captured_errors(spark, d):
    return table(spark, d, "eval_results").select("result_id", "video", "pred_span", "error").distinct().select("result_id", "video", F.when(F.col("error").isNull(), F.size("pred_span")).cast("long").alias("n"), "error")


@query(f"WITH {SQL}, {SCORE_SQL} SELECT event_type, count(*) AS n, round(avg(iou), 6) AS miou FROM sc GROUP BY event_type")
def k3_k4_results(spark, d):
    R.scored(grounding(spark, d)).select("event_type", "iou").write.parquet(path := _place(spark))
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("miou"))


def _texts(df, path):
    """Each row of texts as a file of its own."""
    df.write.option("maxRecordsPerFile", 1).text(path)


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 > 0 THEN p_size ELSE 16 END AS w, CASE WHEN p_partkey % 3 > 0 THEN 9 ELSE 9 END AS h, form FROM part, (VALUES ('array'), ('lines')) AS f(form)")
def s3_s4_array_or_lines(spark, d):
    """The same rows as arrays, one per file of some hundred, and as lines; ids come as text, a missing ratio as 16 to 9."""
    ratio = F.when(F.col("p_partkey") % 3 > 0, F.array(F.col("p_size").cast("int"), F.lit(9)))
    rows = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("id"), ratio.alias("ratio"))
    arrays = rows.groupBy(F.floor(F.col("p_partkey") / 500).alias("file")).agg(F.to_json(F.collect_list(F.struct("p_partkey", "id", "ratio"))).alias("value"))
    _texts(arrays.select("value"), a := _place(spark))
    J.write_lines(rows, b := _place(spark))
    out = None
    for form, path in (("array", a), ("lines", b)):
        back = J.lines_or_array(spark, path, "p_partkey long, id string, ratio array<int>").select("p_partkey", "id", J.ratio_or(F.col("ratio"), [16, 9]).alias("ratio"))
        back = back.select("p_partkey", "id", F.col("ratio")[0].alias("w"), F.col("ratio")[1].alias("h"), F.lit(form).alias("form"))
        out = back if out is None else out.unionByName(back)
    return out


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS of FROM events)
SELECT 'root/v' || user_id || '.mp4' AS video_path, CAST(CASE WHEN user_id % 5 = 0 THEN 0 ELSE 30 + user_id % 121 END AS DOUBLE) AS duration, 'event ' || event_id AS query, CAST(event_id % 40 AS DOUBLE) AS start, CAST(event_id % 40 + 2 AS DOUBLE) AS "end" FROM e WHERE user_id % 3 > 0 OR n < of""")
def s5_annotations(spark, d):
    """Annotation objects, one per user, with either pair of names; durations may be missing, and for some users a span is."""
    u, e = F.col("user_id"), F.col("event_id")
    per = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id"))).alias("e"))
    text = F.transform("e", lambda x: F.concat(F.lit(" event  "), x["event_id"].cast("string"), F.lit(". ")))
    spans = F.transform("e", lambda x: F.array((x["event_id"] % 40).cast("double"), (x["event_id"] % 40 + 2).cast("double")))
    spans = F.when(u % 3 == 0, F.slice(spans, F.lit(1), F.size(spans) - 1)).otherwise(spans)
    either = u % 2 == 0
    info = F.struct(F.when(u % 5 > 0, (30 + u % 121).cast("double")).alias("duration"), F.when(either, text).alias("queries"), F.when(~either, text).alias("sentences"), F.when(either, spans).alias("spans"), F.when(~either, spans).alias("timestamps"))
    objects = per.select(F.to_json(F.create_map(F.concat(F.lit("v"), u.cast("string")), info)).alias("value"))
    _texts(objects.repartition(8), path := _place(spark))
    a = J.annotations(spark, path, "root/")
    return a.select("video_path", "duration", "query", F.col("span")[0][0].alias("start"), F.col("span")[0][1].alias("end"))


@query("WITH b AS (SELECT * FROM (VALUES ('charades', 3363, 0), ('activitynet', 4500, 1), ('qvhighlights', 1541, 2)) AS t(name, listed, k)) SELECT name, listed, count(event_id) AS found, count(event_id) = listed AS complete FROM b LEFT JOIN events ON user_id % 3 = k AND event_type = 'click' GROUP BY 1, 2")
def s6_benches(spark, d):
    """The registered benches, and how many of their events are there."""
    k = F.col("user_id") % 3
    e = table(spark, d, "events").where("event_type = 'click'").select(F.when(k == 0, "charades").when(k == 1, "activitynet").otherwise("qvhighlights").alias("name"), "event_id")
    return J.bench_counts(J.benches(spark), e, "name").select("name", "listed", "found", "complete")


@query("WITH r AS (SELECT DISTINCT ON (rollout_id) * FROM reward_inputs ORDER BY rollout_id) SELECT run_tag, count(*) AS n, round(avg(iou), 6) AS mean FROM r GROUP BY run_tag")
def y1_y2_y6_stream(spark, d):
    """A stream of files, some at a time, stopped after half of them and taken up again at the same place."""
    rows = table(spark, d, "reward_inputs").select("rollout_id", "run_tag", "iou", F.col("finished_at").cast("timestamp").alias("finished_at"))
    cuts = rows.select(F.unix_timestamp("finished_at").alias("t")).approxQuantile("t", [0.25, 0.5, 0.75], 0.01)
    path, place, t = _place(spark), _place(spark), F.unix_timestamp("finished_at")
    out = None
    for i in range(4):
        part = rows.where((t > cuts[i - 1] if i else F.lit(True)) & (t <= cuts[i] if i < 3 else F.lit(True)))
        part.coalesce(2).write.mode("append").parquet(path)
        if i % 2:  # started anew, from the checkpoint
            out = running.running_summary(spark, path, rows.schema, place, "run_tag", "rollout_id", "iou", "finished_at")
    return out.select("run_tag", "n", F.round("mean", 6).alias("mean"))
