"""Conversion, filters and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import conversion as C
from ..operators import sampling as S
from ..operators.ranking import positions, running
from ..storage import table
from .grounding import SQL, grounding

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


INDEX = "idx AS (SELECT name, max_by(duration, line_no) AS duration FROM (SELECT split_part(coalesce(video_path, videos[1]), '/', -1) AS name, line_no, duration FROM duration_sidecar) q WHERE name IS NOT NULL AND duration IS NOT NULL GROUP BY name)"


@query(f"WITH {INDEX} SELECT name, duration FROM idx")
def s12_duration_index(spark, d):
    return C.duration_index(table(spark, d, "duration_sidecar"))


FILLED = f"{INDEX}, filled AS (SELECT r.* EXCLUDE (duration), coalesce(r.duration, idx.duration) AS duration FROM records r LEFT JOIN idx ON split_part(r.videos[1], '/', -1) = idx.name)"


def filled(spark, d):
    return C.with_fallback_duration(table(spark, d, "records"), C.duration_index(table(spark, d, "duration_sidecar")), F.get("videos", F.lit(0)))


@query(f"WITH {FILLED} SELECT row_id, duration FROM filled")
def j1_fallback_duration(spark, d):
    return filled(spark, d).select("row_id", "duration")


REASONS = FILLED + """, g AS (SELECT *, CASE WHEN len(regexp_extract_all(answer, '\\d+\\.?\\d*')) >= 2 THEN greatest(0.0, CAST(regexp_extract_all(answer, '\\d+\\.?\\d*')[2] AS DOUBLE) - CAST(regexp_extract_all(answer, '\\d+\\.?\\d*')[1] AS DOUBLE)) END AS len_ FROM filled),
why AS (SELECT row_id, len_, duration, CASE WHEN NOT coalesce(difficulty >= 0.1 AND difficulty <= 0.9, false) THEN 'difficulty' WHEN NOT coalesce(duration >= 5 AND duration <= 600, false) THEN 'duration' WHEN NOT coalesce(len_ >= 0.5 AND len_ <= 60, false) THEN 'gt_len'
  WHEN NOT coalesce(CASE WHEN duration > 0 THEN len_ / duration END >= 0.01 AND CASE WHEN duration > 0 THEN len_ / duration END <= 0.9, false) THEN 'coverage' END AS reason FROM g)"""


def reasoned(spark, d):
    return C.reasoned(filled(spark, d), (0.1, 0.9), (5, 600), (0.5, 60), (0.01, 0.9))


@query(f"WITH {REASONS} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM why GROUP BY 1")
def f5_skip_account(spark, d):
    return reasoned(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {REASONS} SELECT row_id, round(len_, 4) AS gt_len FROM why WHERE reason IS NULL")
def f1_f4_filtered(spark, d):
    return reasoned(spark, d).where("reason IS NULL").select("row_id", F.round("gt_len", 4).alias("gt_len"))


@query(f"WITH {SQL} SELECT event_id, '<video>' || event_type AS problem, '<answer> ' || CAST(gt_s AS BIGINT) || '.0 to ' || CAST(gt_e AS BIGINT) || '.0 </answer>' AS answer, 'temporal grounding' AS problem_type, 'video' AS data_type, false AS has_offline_trajectory, '' AS offline_output FROM grounding")
def proj_p1_trainer_records(spark, d):
    g = grounding(spark, d).withColumn("gt_len", F.col("gt_e") - F.col("gt_s")).withColumn("v", F.col("event_id").cast("string"))
    rows = C.trainer_records(g, "event_type", "ground_truth", F.col("v"))
    return rows.select(F.col("videos")[0].cast("long").alias("event_id"), "problem", "answer", "problem_type", "data_type", "has_offline_trajectory", "offline_output")


@query("SELECT row_id, row_number() OVER (ORDER BY coalesce(CASE WHEN isnan(difficulty) THEN NULL ELSE difficulty END, -1) DESC, row_id) - 1 AS pos FROM records")
def o1_by_difficulty(spark, d):
    level = F.coalesce(F.nanvl("difficulty", F.lit(None).cast("double")), F.lit(-1.0))
    return positions(table(spark, d, "records").select("row_id", level.alias("level")), F.col("level").desc(), F.col("row_id")).select("row_id", "pos")


@query("SELECT row_id, duration FROM records WHERE duration IS NOT NULL AND NOT isnan(duration) ORDER BY duration DESC, row_id LIMIT 200")
def o2_head(spark, d):
    return table(spark, d, "records").where("duration IS NOT NULL AND NOT isnan(duration)").orderBy(F.col("duration").desc(), "row_id").limit(200).select("row_id", "duration")


LEN = "CASE WHEN l >= 0 AND l < 2 THEN 0 WHEN l >= 2 AND l < 5 THEN 1 WHEN l >= 5 AND l < 10 THEN 2 WHEN l >= 10 AND l < 20 THEN 3 ELSE 4 END"
COV = "CASE WHEN c >= 0 AND c < 0.05 THEN 0 WHEN c >= 0.05 AND c < 0.1 THEN 1 WHEN c >= 0.1 AND c < 0.2 THEN 2 WHEN c >= 0.2 AND c < 0.4 THEN 3 ELSE 4 END"
BUCKETS = f"bk AS (SELECT event_id, difficulty, {LEN} AS lb, {COV} AS cb FROM (SELECT *, gt_e - gt_s AS l, (gt_e - gt_s) / duration AS c FROM grounding))"


def bucketed(spark, d):
    g = grounding(spark, d)
    length = F.col("gt_e") - F.col("gt_s")
    return g.select("event_id", "difficulty", S.bucket(length, S.LENGTH_EDGES).alias("lb"), S.bucket(length / F.col("duration"), S.COVERAGE_EDGES).alias("cb"))


@query(f"WITH {SQL}, {BUCKETS} SELECT CAST(lb AS INTEGER) AS lb, CAST(cb AS INTEGER) AS cb, count(*) AS n FROM bk GROUP BY 1, 2")
def o3_joint_buckets(spark, d):
    return bucketed(spark, d).groupBy("lb", "cb").agg(F.count("*").alias("n"))


WEIGHTS = "w AS (SELECT * FROM (VALUES (0, 0.1325), (1, 0.3232), (2, 0.1940), (3, 0.1410), (4, 0.2094)) AS t(b, share))"
QUOTA = WEIGHTS + ", r AS (SELECT b, CAST(share AS DOUBLE) / 1.0001 * 997 AS raw FROM w), q0 AS (SELECT b, CAST(floor(raw) AS BIGINT) AS base, row_number() OVER (ORDER BY raw - floor(raw) DESC, b) AS n FROM r), quota AS (SELECT b, base + CASE WHEN n <= 997 - (SELECT sum(base) FROM q0) THEN 1 ELSE 0 END AS want FROM q0)"


@query(f"WITH {QUOTA} SELECT b AS bucket, CAST(want AS BIGINT) AS quota FROM quota")
def o4_quotas(spark, d):
    return spark.createDataFrame(list(enumerate(S.quotas(S.LENGTH_SHARES, 997))), "bucket int, quota long")


@query(f"WITH {SQL}, {BUCKETS}, {QUOTA}, k AS (SELECT event_id, lb, row_number() OVER (PARTITION BY lb ORDER BY md5('11:' || event_id)) AS n, count(*) OVER (PARTITION BY lb) AS pool FROM bk) SELECT event_id, CAST(lb AS INTEGER) AS lb FROM (SELECT event_id, lb, unnest(range(0, CAST((want - n) // pool + 1 AS BIGINT))) AS copy FROM k JOIN quota ON lb = b WHERE n <= want)")
def o6_stratified(spark, d):
    return S.stratified(bucketed(spark, d), "lb", S.LENGTH_SHARES, 997, 11, "event_id").select("event_id", "lb")


BIGQ = QUOTA.replace("997", "60000")


@query(f"WITH {SQL}, {BUCKETS}, {BIGQ}, p AS (SELECT lb, count(*) AS pool FROM bk GROUP BY 1) SELECT lb, CAST(want AS BIGINT) AS copies, least(want, pool) AS distinct_ids FROM (SELECT CAST(p.lb AS INTEGER) AS lb, CAST(want AS BIGINT) AS want, pool FROM p JOIN quota ON p.lb = b)")
def o6_oversampled(spark, d):
    s = S.stratified(bucketed(spark, d), "lb", S.LENGTH_SHARES, 60000, 11, "event_id")
    return s.groupBy("lb").agg(F.count("*").alias("copies"), F.countDistinct("event_id").alias("distinct_ids"))


UNIT = "((" + " + ".join(f"(instr('0123456789abcdef', substr(h, {i + 1}, 1)) - 1) * {16 ** (6 - i)}" for i in range(7)) + ") + 0.5) / 268435456.0"


@query(f"""WITH {SQL}, dn AS (SELECT event_id, difficulty, CAST(greatest(0, least(99, floor(difficulty * 100))) AS INTEGER) AS bin, md5('7:' || event_id) AS h FROM grounding), sh AS (SELECT bin, count(*) / (SELECT count(*) FROM dn)::DOUBLE AS share FROM dn GROUP BY 1),
k AS (SELECT event_id, -ln({UNIT}) / (exp(-(difficulty - 0.75) * (difficulty - 0.75) / 0.08) / share) AS o FROM dn JOIN sh ON dn.bin = sh.bin) SELECT event_id FROM k ORDER BY o, event_id LIMIT 500""")
def o7_gaussian(spark, d):
    return S.gaussian(grounding(spark, d).select("event_id", "difficulty"), 500, 0.75, 0.2, 7, "event_id").select("event_id")


@query("SELECT result_id, CAST((row_number() OVER (ORDER BY duration DESC NULLS LAST, result_id) - 1) % 4 AS INTEGER) AS shard FROM (SELECT result_id, any_value(duration) AS duration FROM eval_results GROUP BY 1) q")
def o8_round_robin(spark, d):
    rows = table(spark, d, "eval_results").groupBy("result_id").agg(F.any_value("duration").alias("duration"))
    return positions(rows, F.col("duration").desc_nulls_last(), F.col("result_id")).select("result_id", (F.col("pos") % 4).cast("int").alias("shard"))


@query("SELECT line_no, duration FROM duration_sidecar ORDER BY line_no LIMIT 100")
def o9_first(spark, d):
    return table(spark, d, "duration_sidecar").orderBy("line_no").limit(100).select("line_no", "duration")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def o10_sample_log(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(S.hashed(42, "doc_id"), "doc_id").limit(50)


@query("WITH t AS (SELECT doc_id, coalesce(lang, '__default__') AS task, row_number() OVER (PARTITION BY coalesce(lang, '__default__') ORDER BY md5('42:' || doc_id)) - 1 AS r, count(*) OVER (PARTITION BY coalesce(lang, '__default__')) AS n FROM documents) SELECT doc_id, task, r // 16 AS round FROM t WHERE r // 16 < n // 16")
def o11_task_batches(spark, d):
    return S.task_batches(table(spark, d, "documents"), "lang", 16, 42, "doc_id").select("doc_id", "task", "round")


@query("SELECT doc_id, (row_number() OVER (ORDER BY md5('5:' || doc_id), doc_id) - 1) // 32 AS batch FROM documents")
def o12_sampler(spark, d):
    rows = table(spark, d, "documents").select("doc_id", S.hashed(5, "doc_id").alias("h"))
    return positions(rows, "h", "doc_id").select("doc_id", F.floor(F.col("pos") / 32).alias("batch"))


@query(f"WITH {SQL}, {BUCKETS}, {QUOTA}, p AS (SELECT lb, count(*) AS pool FROM bk GROUP BY 1) SELECT CASE lb WHEN 0 THEN '<2s' WHEN 1 THEN '2-5s' WHEN 2 THEN '5-10s' WHEN 3 THEN '10-20s' ELSE '>20s' END AS bucket, CAST(want AS BIGINT) AS target, pool, CAST(want AS BIGINT) AS kept, CASE WHEN pool < want THEN '+' || (want - pool) || ' dup' ELSE '' END AS note FROM p JOIN quota ON lb = b")
def a15_strata(spark, d):
    return S.summary(bucketed(spark, d), "lb", S.LENGTH_NAMES, S.LENGTH_SHARES, 997)


@query(f"WITH {SQL} SELECT CAST(least(99, floor(difficulty * 100)) AS INTEGER) AS bin, round(count(*) / (SELECT count(*) FROM grounding), 6) AS share FROM grounding GROUP BY 1")
def a16_density(spark, d):
    return S.density(grounding(spark, d), "difficulty").select("bin", F.round("share", 6).alias("share"))


@query("SELECT coalesce(problem_type, '__default__') AS task, count(*) AS n FROM records GROUP BY 1")
def a14_tasks(spark, d):
    return table(spark, d, "records").groupBy(F.coalesce("problem_type", F.lit("__default__")).alias("task")).agg(F.count("*").alias("n"))


SUMMARY = "count(*) AS n, round(100 * avg(iou), 2) AS miou, round(100 * avg(CASE WHEN iou >= 0.3 THEN 1.0 ELSE 0.0 END), 2) AS r3, round(100 * avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END), 2) AS r5, round(100 * avg(CASE WHEN iou >= 0.7 THEN 1.0 ELSE 0.0 END), 2) AS r7, round(100 * avg(CASE WHEN len(pred_span) = 2 AND error IS NULL THEN 1.0 ELSE 0.0 END), 2) AS parse_rate"


def bench(rows, *by):
    """Number of results, mean overlap, recall at three thresholds and the share that could be read, in per cent."""
    share = lambda c: F.round(100 * F.avg(F.when(c, 1.0).otherwise(0.0)), 2)
    read = (F.size("pred_span") == 2) & F.col("error").isNull()
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(100 * F.avg("iou"), 2).alias("miou"), share(F.col("iou") >= 0.3).alias("r3"), share(F.col("iou") >= 0.5).alias("r5"), share(F.col("iou") >= 0.7).alias("r7"), share(read).alias("parse_rate"))


def results(spark, d):
    return table(spark, d, "eval_results").dropDuplicates(["result_id"])


ONE = "res AS (SELECT DISTINCT ON (result_id) * FROM eval_results ORDER BY result_id)"


@query(f"WITH {ONE} SELECT run_tag, {SUMMARY} FROM res GROUP BY run_tag")
def a1_bench_summary(spark, d):
    return bench(results(spark, d), "run_tag")


@query(f"WITH {ONE}, sh AS (SELECT *, round(iou, 4) AS i4 FROM res) SELECT {SUMMARY.replace('iou', 'i4').replace('mi4', 'miou')} FROM sh")
def a2_shard_merge(spark, d):
    shards = [results(spark, d).where(F.pmod("result_id", F.lit(3)) == k) for k in range(3)]
    merged = shards[0]
    for s in shards[1:]:
        merged = merged.unionByName(s, allowMissingColumns=True)
    return bench(merged.withColumn("iou", F.round("iou", 4)))


@query(f"WITH {ONE}, o AS (SELECT *, row_number() OVER (ORDER BY result_id) AS k FROM res), c AS (SELECT k, count(*) OVER w AS n, avg(iou) OVER w AS m FROM o WINDOW w AS (ORDER BY k)) SELECT k, n, round(100 * m, 4) AS running FROM c WHERE k % 50 = 0")
def y2_running_metrics(spark, d):
    rows = running(results(spark, d).select("result_id", "iou", F.col("iou").isNotNull().cast("long").alias("one")), "iou", "result_id")
    rows = running(rows.drop("pos"), "one", "result_id", name="known")
    return rows.where("(pos + 1) % 50 = 0").select((F.col("pos") + 1).alias("k"), (F.col("pos") + 1).alias("n"), F.round(100 * F.col("running") / F.col("known"), 4).alias("running"))
