"""Metrics, checkpoints, prompts and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch as B
from ..operators import checkpoints as K
from ..operators import metrics as M
from ..operators import prompts as Q
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


def rollouts(spark, d):
    return table(spark, d, "reward_inputs").dropDuplicates(["rollout_id"])


ROLL = "roll AS (SELECT DISTINCT ON (rollout_id) * FROM reward_inputs ORDER BY rollout_id)"


@query(f"WITH {ROLL}, s AS (SELECT run_tag, step, avg(CASE WHEN isfinite(overall) THEN overall END) AS v FROM roll GROUP BY 1, 2) SELECT run_tag AS metric, round(avg(v), 6) AS value FROM s GROUP BY 1")
def a3_means(spark, d):
    per = rollouts(spark, d).groupBy(F.col("run_tag").alias("metric"), "step").agg(F.avg(F.nanvl("overall", F.lit(None).cast("double"))).alias("value"))
    return M.means(per).select("metric", F.round("value", 6).alias("value"))


def _long_sql(pairs: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS value FROM {source}" for k, v in pairs.items())


@query(f"WITH {ROLL}, l AS (SELECT length(problem) AS p, response_length AS r FROM roll) " + _long_sql({
    "response_length/mean": "round(avg(r), 6)", "response_length/max": "max(r)", "response_length/min": "min(r)", "response_length/clip_ratio": "round(avg(CASE WHEN r = 256 THEN 1.0 ELSE 0.0 END), 6)",
    "prompt_length/mean": "round(avg(p), 6)", "prompt_length/max": "max(p)", "prompt_length/min": "min(p)", "prompt_length/clip_ratio": "round(avg(CASE WHEN p = 300 THEN 1.0 ELSE 0.0 END), 6)"}, "l"))
def a4_lengths(spark, d):
    rows = rollouts(spark, d).select(F.length("problem").alias("p"), F.col("response_length").alias("r"))
    return M.lengths(rows, "p", "r", 300, 256).select("metric", F.round("value", 6).alias("value"))


@query(f"WITH {SEQ}, s AS (SELECT uid, sum(r) AS s FROM tok GROUP BY uid), " + "l AS (" + _long_sql({
    "score/mean": "round(avg(s), 6)", "score/max": "round(max(s), 6)", "score/min": "round(min(s), 6)"}, "s") + " UNION ALL " + _long_sql({
    "advantages/mean": "round(avg(a), 6)", "advantages/max": "round(max(a), 6)", "advantages/min": "round(min(a), 6)", "values/mean": "round(avg(v), 6)", "values/max": "round(max(v), 6)", "values/min": "round(min(v), 6)"}, "tok WHERE m = 1") + ") SELECT * FROM l")
def a5_data_metrics(spark, d):
    s = sequences(spark, d)
    score = s.agg(*M.spread("score", F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x)))
    tokens = s.select(F.explode(F.arrays_zip("adv", "values", "mask")).alias("x")).where("x.mask = 1").agg(*M.spread("advantages", F.col("x.adv")), *M.spread("values", F.col("x.values")))
    return M.long(score).unionByName(M.long(tokens)).select("metric", F.round("value", 6).alias("value"))


@query(f"WITH {SEQ} SELECT uid % 10 AS part, round(1 - var_samp(r - v) / (var_samp(r) + 1e-5), 6) AS explained FROM tok WHERE m = 1 GROUP BY 1")
def a6_explained_variance(spark, d):
    t = sequences(spark, d).select((F.col("uid") % 10).alias("part"), F.explode(F.arrays_zip("rewards", "values", "mask")).alias("x")).where("x.mask = 1")
    return t.groupBy("part").agg(F.round(M.explained_variance(F.col("x.rewards"), F.col("x.values")), 6).alias("explained"))


TIMES = [("gen", 41.5, "response"), ("reward", 3.25, "response"), ("old", 12.0, "all"), ("update_actor", 77.75, "all"), ("adv", 0.5, "all")]
TIMES_SQL = "tm AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, '{c}')" for a, b, c in TIMES) + ") AS t(section, seconds, of))"


@query(f"WITH {ROLL}, {TIMES_SQL}, k AS (SELECT run_tag, CAST(sum(response_length) AS BIGINT) AS response, CAST(sum(response_length + length(problem)) AS BIGINT) AS whole FROM roll WHERE response_length IS NOT NULL GROUP BY 1) SELECT run_tag, section, round(seconds * 1000 / CASE WHEN of = 'response' THEN response ELSE whole END, 6) AS ms_per_token FROM k, tm")
def a7_timing(spark, d):
    tokens = rollouts(spark, d).where("response_length IS NOT NULL").groupBy("run_tag").agg(F.sum("response_length").alias("response"), F.sum(F.col("response_length") + F.length("problem")).alias("all"))
    return M.timing_per_token(tokens, TIMES).select("run_tag", "section", F.round("ms_per_token", 6).alias("ms_per_token"))


@query(f"WITH {ROLL} SELECT run_tag, CAST(sum(response_length) AS BIGINT) AS tokens, round(sum(response_length) / (120.5 * 8), 6) AS throughput FROM roll GROUP BY 1")
def a8_throughput(spark, d):
    return M.throughput(M.token_totals(rollouts(spark, d), "response_length", "run_tag"), 120.5, 8).select("run_tag", "tokens", F.round("throughput", 6).alias("throughput"))


@query(f"WITH {ROLL} SELECT run_tag, step, CAST(sum(response_length) AS BIGINT) AS tokens FROM roll GROUP BY 1, 2")
def a13_tokens(spark, d):
    return M.token_totals(rollouts(spark, d), "response_length", "run_tag", "step")


@query("SELECT row_id, CASE WHEN isnan(difficulty) OR isinf(difficulty) THEN 0.0 ELSE difficulty END AS difficulty FROM records")
def a19_finite(spark, d):
    return table(spark, d, "records").select("row_id", M.finite(F.col("difficulty")).alias("difficulty"))


@query(f"WITH {ROLL} SELECT 'iou' AS metric, round(avg(iou), 6) AS value FROM roll UNION ALL SELECT 'format', round(avg(format_score), 6) FROM roll")
def a21_across_workers(spark, d):
    r = rollouts(spark, d)
    parts = [r.where(F.pmod("rollout_id", F.lit(2)) == k).select(F.explode(F.array(F.struct(F.lit("iou").alias("metric"), F.col("iou").alias("value")), F.struct(F.lit("format").alias("metric"), F.col("format_score").alias("value")))).alias("m")).select("m.*") for k in (0, 1)]
    return M.means(B.concatenated(parts)).select("metric", F.round("value", 6).alias("value"))


STEPS = "st AS (SELECT DISTINCT event_id % 1000 * 10 AS step FROM events)"


@query(f"WITH {STEPS}, o AS (SELECT step, row_number() OVER (ORDER BY step = 4210, step DESC) AS r FROM st WHERE step < 9000) SELECT step, step = 4210 OR r <= 3 AS keep FROM o")
def o13_retained(spark, d):
    steps = table(spark, d, "events").select((F.col("event_id") % 1000 * 10).alias("step")).distinct()
    return K.retained(steps, 9000, 4210, 5)


FILES = "fl AS (SELECT event_id, 'global_step_' || (event_id % 100) || CASE WHEN event_id % 17 = 0 THEN '_bak' ELSE '' END AS folder, CASE event_id % 4 WHEN 0 THEN 'model_' || (event_id % 8) || '.pt' WHEN 1 THEN 'optim_' || (event_id % 8) || '.pt' WHEN 2 THEN 'extra_state_1.pt' ELSE 'dataloader.pt' END AS name FROM events)"


@query(f"WITH {FILES} SELECT event_id, CAST(regexp_extract(folder, '^global_step_(\\d+)$', 1) AS BIGINT) AS step FROM fl WHERE regexp_matches(folder, '^global_step_\\d+$') AND folder <> 'global_step_42' AND event_id % 4 > 0")
def y8_thinned(spark, d):
    files = table(spark, d, "events").select("event_id", F.expr("'global_step_' || (event_id % 100) || CASE WHEN event_id % 17 = 0 THEN '_bak' ELSE '' END").alias("folder"), F.expr("CASE event_id % 4 WHEN 0 THEN 'model_' || (event_id % 8) || '.pt' WHEN 1 THEN 'optim_' || (event_id % 8) || '.pt' WHEN 2 THEN 'extra_state_1.pt' ELSE 'dataloader.pt' END").alias("name"))
    return K.thinned(files, 42).select("event_id", "step")


@query("SELECT event_id, CASE WHEN starts_with(k, 'model.language_model.visual.') THEN 'model.visual.' || substr(k, 29) ELSE k END AS renamed, CASE WHEN regexp_matches(k, '^model\\.language_model') THEN regexp_replace(k, '^model\\.language_model', 'model') ELSE k END AS mapped FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'model.language_model.visual.b' ELSE 'model.language_model.layers.' END || event_id AS k FROM events) q")
def proj_p16_p17_key_names(spark, d):
    k = F.expr("CASE WHEN event_id % 3 = 0 THEN 'model.language_model.visual.b' ELSE 'model.language_model.layers.' END || event_id")
    return table(spark, d, "events").select("event_id", K.renamed_keys(k, [("model.language_model.visual.", "model.visual.")]).alias("renamed"), K.pattern_renamed(k, [(r"^model\.language_model", "^model")]).alias("mapped"))


@query("SELECT 'w' || (p_partkey % 50) AS key FROM part UNION SELECT 'b' || (p_size % 10) FROM part")
def s16_listed_keys(spark, d):
    text = F.expr("'{\"weight_map\": {\"w' || (p_partkey % 50) || '\": \"f1\", \"b' || (p_size % 10) || '\": \"f2\"}}'")
    return table(spark, d, "part").select(F.explode(K.listed_keys(text)).alias("key")).distinct()


@query("SELECT uid_ AS head, CAST(len(list(metric)) AS INTEGER) AS n, round(sum(value), 4) AS total FROM (SELECT event_type AS uid_, user_id AS metric, avg(value) AS value FROM events GROUP BY 1, 2) q GROUP BY 1")
def proj_p18_nested(spark, d):
    m = table(spark, d, "events").groupBy(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("metric")).agg(F.avg("value").alias("value"))
    n = M.nested(m)
    back = M.flat(n).groupBy(F.substring_index("metric", "/", 1).alias("head")).agg(F.sum("value").alias("total"))
    return n.select("head", F.size("values").alias("n")).join(back, "head").select("head", "n", F.round("total", 4).alias("total"))


MODELS = "CASE event_id % 5 WHEN 0 THEN 'Third-VL' WHEN 1 THEN 'second.5' WHEN 2 THEN 'Own-7B' WHEN 3 THEN 'own-8b' ELSE 'other' END"
FAMILIES = [("third", 32, ["third", "own-8b"]), ("second", 28, ["second", "own-7b"])]


@query(f"SELECT event_id, CASE WHEN m LIKE '%own-%' THEN 'plain' WHEN event_id % 2 = 0 THEN 'thinking' WHEN event_id % 3 = 0 THEN 'bare' ELSE 'plain' END AS prompt, CAST(CASE WHEN m LIKE '%third%' OR m LIKE '%own-8b%' THEN 32 WHEN m LIKE '%second%' OR m LIKE '%own-7b%' THEN 28 ELSE 32 END AS INTEGER) AS rate, CASE WHEN m LIKE '%third%' OR m LIKE '%own-8b%' THEN 'third' WHEN m LIKE '%second%' OR m LIKE '%own-7b%' THEN 'second' ELSE 'third' END AS family FROM (SELECT event_id, lower({MODELS}) AS m FROM events) q")
def proj_p7_p8_setup(spark, d):
    s = Q.evaluation_setup(F.expr(MODELS), F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0, ["own-"], FAMILIES)
    return table(spark, d, "events").select("event_id", s.alias("s")).select("event_id", "s.*")


@query("SELECT row_id, CASE WHEN row_id % 7 = 0 THEN 'inline' WHEN preprocessed_video IS NOT NULL AND row_id % 3 > 0 THEN 'preprocessed' ELSE 'path' END AS source_type, CAST(CASE WHEN row_id % 7 > 0 AND preprocessed_video IS NOT NULL AND row_id % 3 > 0 THEN 1 ELSE coalesce(len(videos), -1) END AS INTEGER) AS n FROM records")
def proj_p19_p20_source(spark, d):
    mode = Q.source_mode(F.when(F.col("row_id") % 3 == 0, "realtime_only"), F.lit(True))
    s = Q.video_source(mode, F.col("videos"), F.col("preprocessed_video"), F.when(F.col("row_id") % 7 == 0, 4).otherwise(0))
    return table(spark, d, "records").select("row_id", s["source_type"].alias("source_type"), F.coalesce(F.size(s["paths"]), F.lit(-1)).alias("n"))


@query("SELECT row_id, CASE WHEN row_id % 11 = 0 AND row_id % 5 <> 4 THEN 'both images and video' WHEN row_id % 5 = 3 THEN 'unknown source' WHEN coalesce(len(videos), 0) = 0 AND (row_id % 5 <> 4 OR videos IS NOT NULL) THEN CASE WHEN row_id % 11 = 0 AND videos IS NOT NULL THEN 'both images and video' ELSE 'no paths' END WHEN row_id % 11 = 0 AND row_id % 5 = 4 AND videos IS NOT NULL THEN 'both images and video' WHEN row_id % 5 = 0 THEN 'frames and metadata differ' END AS fault FROM records")
def f7_contract(spark, d):
    r = F.col("row_id")
    kind = F.when(r % 5 == 3, "odd").when(r % 5 == 0, "inline").when(r % 5 != 4, "path")
    fault = Q.contract_fault(F.when(r % 11 == 0, 2), kind, F.col("videos"), F.lit(3), F.lit(2))
    return table(spark, d, "records").select("row_id", fault.alias("fault"))


@query("WITH a AS (SELECT p_partkey, CAST(p_size * 20 + 100 AS DOUBLE) AS w, CAST((p_partkey % 50) * 10 + 100 AS DOUBLE) AS h FROM part), b AS (SELECT p_partkey, CASE WHEN w * h > 200000 THEN floor(w * sqrt(200000.0 / (w * h))) ELSE w END AS w, CASE WHEN w * h > 200000 THEN floor(h * sqrt(200000.0 / (w * h))) ELSE h END AS h FROM a) SELECT p_partkey, CAST(CASE WHEN w * h < 60000 THEN floor(w * sqrt(60000.0 / (w * h))) ELSE w END AS BIGINT) AS w, CAST(CASE WHEN w * h < 60000 THEN floor(h * sqrt(60000.0 / (w * h))) ELSE h END AS BIGINT) AS h FROM b")
def m11_resized(spark, d):
    s = Q.resized((F.col("p_size") * 20 + 100).cast("double"), ((F.col("p_partkey") % 50) * 10 + 100).cast("double"), 60_000, 200_000)
    return table(spark, d, "part").select("p_partkey", s["w"].alias("w"), s["h"].alias("h"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_partkey / CAST(p_size % 4 AS DOUBLE) END AS duration, CAST(p_size % 4 AS DOUBLE) AS fps FROM part")
def m12_metadata(spark, d):
    m = Q.fallback_metadata(F.col("p_partkey"), (F.col("p_size") % 4).cast("double"))
    return table(spark, d, "part").select("p_partkey", m["duration"].alias("duration"), m["fps"].alias("fps"))


@query("SELECT p_partkey, round(p_retailprice / 1000.0 / 1000.0, 9) AS m, CAST(ceil(p_partkey / 7.0) AS BIGINT) AS parts FROM part")
def m13_m14_units(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") / (1 / M.in_unit(1.0, "M")), 9).alias("m"), F.ceil(F.col("p_partkey") / 7.0).alias("parts"))


@query("SELECT event_id, CASE WHEN k % 9 < 2 THEN CAST(-100 AS DOUBLE) END AS bias FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) q")
def m17_bias(spark, d):
    k = F.get_json_object("props", "$.k").cast("long") % 9
    bias = F.create_map(F.lit(0).cast("long"), F.lit(-100.0), F.lit(1).cast("long"), F.lit(-100.0))
    return table(spark, d, "events").select("event_id", F.try_element_at(bias, k).alias("bias"))


@query("SELECT count(*) AS todo FROM (SELECT DISTINCT record_id FROM records EXCEPT SELECT record_id FROM eval_results) q")
def s8_y3_resume(spark, d):
    return B.missing_keys(table(spark, d, "records"), table(spark, d, "eval_results"), "record_id").agg(F.count("*").alias("todo"))


@query("""WITH d AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'NVIDIA A100-SXM' WHEN 1 THEN 'NVIDIA H20' ELSE 'other' END AS device, CAST(n_chars AS DOUBLE) AS n FROM documents), t AS (SELECT device, sum(n) AS tokens, sum(n * n) * 12 * 128 * 32 * 36 AS attention FROM d GROUP BY 1),
f AS (SELECT device, tokens, (6.0 * ((3.0 * 2560 * 9728 + 2560.0 * 128 * (32 + 8 + 8 + 32)) * 36 + 151936.0 * 2560 * 2) * tokens + attention) / 2.5 / 1e12 AS dense, (6.0 * ((2560.0 * 8 * 768 * 3 + 2560 * 128 + 2560.0 * 128 * (32 + 8 + 8 + 32)) * 36 + 151936.0 * 2560 * 2) * tokens + attention) / 2.5 / 1e12 AS moe FROM t)
SELECT device, CAST(tokens AS BIGINT) AS tokens, round(dense, 3) AS dense, round(moe, 3) AS moe, round(CASE device WHEN 'NVIDIA A100-SXM' THEN dense / 312.0 / 4 WHEN 'NVIDIA H20' THEN dense / 148.0 / 4 ELSE 0.0 END, 6) AS utilisation FROM f""")
def a18_flops(spark, d):
    """Dense and mixture-of-experts models, and the share of the peak of four devices, for known devices and another."""
    k = F.col("doc_id") % 3
    rows = table(spark, d, "documents").select(F.when(k == 0, "NVIDIA A100-SXM").when(k == 1, "NVIDIA H20").otherwise("other").alias("device"), "n_chars")
    dense, moe = M.weights(2560, 151936, 36, 32, 8, 9728, 128), M.moe_weights(2560, 151936, 36, 32, 8, 768, 128, 8, 128)
    a = M.flops(rows, "n_chars", 2.5, dense, 128, 32, 36, by=["device"]).select("device", "tokens", F.col("tflops").alias("dense"))
    b = M.flops(rows, "n_chars", 2.5, moe, 128, 32, 36, by=["device"]).select("device", F.col("tflops").alias("moe"))
    used = M.utilisation(F.col("dense"), F.col("device"), F.lit(4))
    return a.join(b, "device").select("device", "tokens", F.round("dense", 3).alias("dense"), F.round("moe", 3).alias("moe"), F.round(used, 6).alias("utilisation"))


@query("SELECT source, count(*) AS files, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes, round(coalesce(sum(n_chars), 0) / 1000000.0, 6) AS shown FROM documents GROUP BY 1")
def a17_sizes(spark, d):
    return M.size_rollup(table(spark, d, "documents"), "source", "n_chars", "M").select("source", "files", "bytes", F.round("shown", 6).alias("shown"))


@query(f"WITH {SEQ} SELECT uid, uid % 3 > 0 AS even, count(*) AS n FROM tok GROUP BY uid")
def u11_u12_checked(spark, d):
    """Arrays of one length, and for some groups one that is shorter."""
    from ..operators.dispatch import consistent
    s = sequences(spark, d).withColumn("mask", F.when(F.col("uid") % 3 == 0, F.slice("mask", 1, 3)).otherwise(F.col("mask")))
    return s.select("uid", consistent(s, ["rewards", "values", "mask"]).alias("even"), F.size("rewards").cast("long").alias("n"))
