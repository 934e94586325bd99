"""Parsing, format checks, overlap and reward."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import parsing as P
from ..operators import reward as R
from ..storage import table
from .grounding import SQL, grounding

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


N = r"(\d+\.?\d*)"
BODY = r"CASE WHEN regexp_matches({0}, '(?s)<answer>(.*?)</answer>') THEN regexp_extract({0}, '(?s)<answer>(.*?)</answer>', 1) ELSE {0} END"


def rewarded_sql(text: str) -> tuple[str, str]:
    """The two ends of a rewarded span of an expression, in SQL."""
    body = "(" + BODY.format(text) + ")"

    def end(i: int) -> str:
        link = lambda p: f"TRY_CAST(regexp_extract_all({body}, '{N}\\s*{p}\\s*{N}', {i})[-1] AS DOUBLE)"
        return f"coalesce({link('(?:to|and)')}, {link('-')}, CASE WHEN len(regexp_extract_all({body}, '\\b{N}\\b', 1)) >= 2 THEN TRY_CAST(regexp_extract_all({body}, '\\b{N}\\b', 1)[{i}] AS DOUBLE) END)"

    return end(1), end(2)


def iou_sql(a0, a1, b0, b1) -> str:
    return (f"CASE WHEN {a0} IS NULL OR {a1} IS NULL OR {b0} IS NULL OR {b1} IS NULL THEN NULL WHEN greatest({a1},{b1}) - least({a0},{b0}) > 0 "
            f"THEN greatest(0.0, least({a1},{b1}) - greatest({a0},{b0})) / (greatest({a1},{b1}) - least({a0},{b0})) ELSE 0.0 END")


RS, RE_ = rewarded_sql("response")
TS, TE = rewarded_sql("ground_truth")


@query("SELECT record_id, row_id, TRY_CAST(regexp_extract_all(answer, '\\d+\\.?\\d*')[1] AS DOUBLE) AS s, TRY_CAST(regexp_extract_all(answer, '\\d+\\.?\\d*')[2] AS DOUBLE) AS e FROM records WHERE len(regexp_extract_all(answer, '\\d+\\.?\\d*')) >= 2")
def x1_first_numbers(spark, d):
    s = P.first_numbers(F.col("answer"))
    return table(spark, d, "records").select("record_id", "row_id", s.alias("x")).where("x IS NOT NULL").select("record_id", "row_id", "x.start", "x.end").toDF("record_id", "row_id", "s", "e")


EVAL_SQL = f"""
ev0 AS (SELECT *, lower(response) AS low FROM grounding),
ev1 AS (SELECT *, CASE WHEN regexp_matches(low, '<answer>\\s*([^\\n]*?)\\s*</answer>') THEN regexp_extract(low, '<answer>\\s*([^\\n]*?)\\s*</answer>', 1) ELSE low END AS body FROM ev0),
ev2 AS (SELECT *, regexp_extract_all(body, '\\b\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?(?:\\.\\d+)?\\b') AS clocks, regexp_extract_all(body, '{N}\\s*-\\s*{N}', 1) AS d1, regexp_extract_all(body, '{N}\\s*-\\s*{N}', 2) AS d2,
  regexp_extract_all(body, '{N}\\s+to\\s+{N}', 1) AS t1, regexp_extract_all(body, '{N}\\s+to\\s+{N}', 2) AS t2, regexp_extract_all(body, '\\b(\\d+\\.\\d+|\\d+)\\b', 1) AS n FROM ev1),
evals AS (SELECT *, CASE WHEN len(clocks) >= 2 THEN CAST(split_part(clocks[1], ':', 1) AS DOUBLE) * 60 + CAST(split_part(clocks[1], ':', 2) AS DOUBLE) WHEN len(d1) > 0 THEN CAST(d1[1] AS DOUBLE) WHEN len(t1) > 0 THEN CAST(t1[1] AS DOUBLE) WHEN len(n) >= 2 THEN CAST(n[1] AS DOUBLE) END AS e_s,
  CASE WHEN len(clocks) >= 2 THEN CAST(split_part(clocks[2], ':', 1) AS DOUBLE) * 60 + CAST(split_part(clocks[2], ':', 2) AS DOUBLE) WHEN len(d1) > 0 THEN CAST(d2[1] AS DOUBLE) WHEN len(t1) > 0 THEN CAST(t2[1] AS DOUBLE) WHEN len(n) >= 2 THEN CAST(n[2] AS DOUBLE) END AS e_e FROM ev2)
"""


@query(f"WITH {SQL}, {EVAL_SQL} SELECT event_id, e_s, e_e FROM evals")
def x2_evaluated_span(spark, d):
    s = P.evaluated_span(F.col("response"))
    return grounding(spark, d).select("event_id", s["start"].alias("e_s"), s["end"].alias("e_e"))


@query(f"WITH {SQL} SELECT event_id, {RS} AS s, {RE_} AS e FROM grounding")
def x3_rewarded_span(spark, d):
    return grounding(spark, d).select("event_id", P.rewarded_span(F.col("response")).alias("x")).select("event_id", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


BOX_TEXT = "'(' || p_size || ',' || (p_partkey % 40) || '), (' || (p_size + p_partkey % 30) || ',' || (p_partkey % 40 + p_size % 25) || ')'"
BOX_TRUTH = "'box ' || (p_size % 30) || ' ' || (p_partkey % 45) || ' ' || (p_size % 30 + 20) || ' ' || (p_partkey % 45 + 15)"
BOXES_SQL = f"boxes AS (SELECT p_partkey, {BOX_TEXT} AS said, {BOX_TRUTH} AS truth FROM part)"


def _boxes(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(BOX_TEXT).alias("said"), F.expr(BOX_TRUTH).alias("truth"))


@query(f"WITH {BOXES_SQL} SELECT p_partkey, CAST(regexp_extract_all(said, '\\d+')[1] AS DOUBLE) AS x1, CAST(regexp_extract_all(said, '\\d+')[4] AS DOUBLE) AS y2, CAST(regexp_extract_all(truth, '\\d+')[3] AS DOUBLE) AS t FROM boxes")
def x4_box(spark, d):
    a, b = P.box(F.col("said")), P.box(F.col("truth"))
    return _boxes(spark, d).select("p_partkey", a[0].alias("x1"), a[3].alias("y2"), b[2].alias("t"))


BOX_IOU = """SELECT p_partkey, a, b, greatest(0, least(a[3],b[3]) - greatest(a[1],b[1])) * greatest(0, least(a[4],b[4]) - greatest(a[2],b[2])) AS i,
  greatest(0, a[3]-a[1]) * greatest(0, a[4]-a[2]) + greatest(0, b[3]-b[1]) * greatest(0, b[4]-b[2]) AS t FROM (
  SELECT p_partkey, list_transform(regexp_extract_all(said, '\\d+'), lambda x: CAST(x AS DOUBLE)) AS a, list_transform(regexp_extract_all(truth, '\\d+'), lambda x: CAST(x AS DOUBLE)) AS b FROM boxes)"""


@query(f"WITH {BOXES_SQL}, u AS ({BOX_IOU}) SELECT p_partkey, round(CASE WHEN t - i > 0 THEN i / (t - i) ELSE 0.0 END, 6) AS iou FROM u")
def m2_box_iou(spark, d):
    return _boxes(spark, d).select("p_partkey", F.round(G.box_iou(P.box(F.col("said")), P.box(F.col("truth"))), 6).alias("iou"))


@query("SELECT rollout_id, trim(regexp_replace(regexp_replace(regexp_extract_all(response, '(?s)<answer>(.*?)</answer>', 1)[-1], '^\\s+', ''), '\\s+$', '')) AS answer, count(*) AS copies FROM reward_inputs GROUP BY 1, 2")
def x5_last_answer(spark, d):
    return table(spark, d, "reward_inputs").select("rollout_id", P.last_answer(F.col("response")).alias("answer")).groupBy("rollout_id", "answer").agg(F.count("*").alias("copies"))


SEG_TEXT = "'{\"segments\": [[' || (event_id % 50) || ', ' || (event_id % 50 + 3) || '], [' || (event_id % 90) || '.5, ' || (event_id % 90 + 7) || ']]}'"


@query(f"WITH s AS (SELECT event_id, {SEG_TEXT} AS t FROM events) SELECT event_id, CAST(len(regexp_extract_all(t, '\\[\\s*(-?\\d+\\.?\\d*)\\s*,\\s*(-?\\d+\\.?\\d*)\\s*\\]', 1)) AS INTEGER) AS n, CAST(regexp_extract_all(t, '\\[\\s*(-?\\d+\\.?\\d*)\\s*,\\s*(-?\\d+\\.?\\d*)\\s*\\]', 1)[2] AS DOUBLE) AS a, CAST(regexp_extract_all(t, '\\[\\s*(-?\\d+\\.?\\d*)\\s*,\\s*(-?\\d+\\.?\\d*)\\s*\\]', 2)[2] AS DOUBLE) AS b FROM s")
def x6_segments(spark, d):
    s = P.segments(F.expr(SEG_TEXT))
    return table(spark, d, "events").select("event_id", F.size(s).alias("n"), s[1]["start"].alias("a"), s[1]["end"].alias("b"))


POINT_TEXT = "CASE WHEN event_id % 3 = 0 THEN '{\"center\": [0.' || (event_id % 10) || ', ' || (event_id % 900) || ']}' WHEN event_id % 3 = 1 THEN 'I think ' || (event_id % 1000) || ' and ' || (event_id % 3000) ELSE 'none' END"


@query(f"""WITH s AS (SELECT event_id, {POINT_TEXT} AS t FROM events), v AS (SELECT event_id, list_transform(regexp_extract_all(t, '-?\\d+\\.?\\d*'), lambda x: CAST(x AS DOUBLE)) AS n FROM s),
w AS (SELECT event_id, n[-2] AS x, n[-1] AS y FROM v)
SELECT event_id, round(CASE WHEN x <= 1.5 THEN greatest(0.0, least(1.0, x)) WHEN x > 1000 THEN least(1.0, x / 640) ELSE x / 1000 END, 6) AS x, round(CASE WHEN y <= 1.5 THEN greatest(0.0, least(1.0, y)) WHEN y > 1000 THEN least(1.0, y / 360) ELSE y / 1000 END, 6) AS y FROM w""")
def x7_focus_point(spark, d):
    p = P.focus_point(F.expr(POINT_TEXT), F.lit(640.0), F.lit(360.0))
    return table(spark, d, "events").select("event_id", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


@query("SELECT row_id, substring(md5(concat_ws('_', preprocessed_video, 'fps=2.0', data_type)), 1, 16) AS name FROM records")
def x8_artifact_name(spark, d):
    return table(spark, d, "records").select("row_id", P.artifact_name(F.col("preprocessed_video"), F.lit("fps=2.0"), F.col("data_type")).alias("name"))


@query(f"WITH {SQL} SELECT event_id, '<answer> ' || CAST({TS} AS BIGINT) || '.00 to ' || CAST({TE} AS BIGINT) || '.00 </answer>' AS reference FROM grounding")
def x9_reference_response(spark, d):
    return grounding(spark, d).select("event_id", P.reference_response(F.col("ground_truth")).alias("reference"))


@query(f"WITH {SQL}, s AS (SELECT event_id, event_type, {RS} AS s, {RE_} AS e, gt_s, gt_e FROM grounding) SELECT event_id, event_type, round({iou_sql('s','e','gt_s','gt_e')}, 6) AS iou FROM s")
def m1_span_iou(spark, d):
    s = P.rewarded_span(F.col("response"))
    return grounding(spark, d).select("event_id", "event_type", F.round(G.span_iou(s["start"], s["end"], F.col("gt_s"), F.col("gt_e")), 6).alias("iou"))


SHAPED = "CASE WHEN {0} >= 0.8 THEN 0.8 + ln({0} - 0.8 + 1) * 0.01 ELSE 0.8 - (exp(1.0 * (0.8 - {0})) - 1) / (exp(1.0) - 1) END"


@query("SELECT result_id, round(" + SHAPED.format("iou") + ", 6) AS shaped FROM (SELECT DISTINCT result_id, iou FROM eval_results) AS q")
def m3_shaped(spark, d):
    return table(spark, d, "eval_results").select("result_id", "iou").distinct().select("result_id", F.round(G.shaped(F.col("iou")), 6).alias("shaped"))


FORMAT_LOOSE = "CASE WHEN regexp_matches({0}, '(?s)<answer>(.*?)</answer>') AND regexp_matches(regexp_extract({0}, '(?s)<answer>(.*?)</answer>', 1), '\\d+\\.?\\d*\\s*(?:to|and|-)\\s*\\d+\\.?\\d*') THEN 1.0 ELSE 0.0 END"
FORMAT_STRICT = "CASE WHEN " + FORMAT_LOOSE.format("{0}") + " = 1.0 AND len(regexp_extract_all({0}, '(?s)<answer>(.*?)</answer>', 1)) = 1 AND regexp_matches({0}, '</answer>\\s*$') AND NOT regexp_matches(regexp_extract({0}, '(?s)<answer>(.*?)</answer>', 1), '[\\n\\r]') THEN 1.0 ELSE 0.0 END"


@query(f"SELECT run_tag, CAST(sum(CAST({FORMAT_LOOSE.format('response')} AS DOUBLE)) AS DOUBLE) AS loose, CAST(sum(CAST({FORMAT_STRICT.format('response')} AS DOUBLE)) AS DOUBLE) AS strict FROM reward_inputs WHERE response IS NOT NULL GROUP BY run_tag")
def f8_span_format(spark, d):
    r = F.col("response")
    return table(spark, d, "reward_inputs").where(r.isNotNull()).groupBy("run_tag").agg(F.sum(R.span_format(r)).alias("loose"), F.sum(R.span_format(r, True)).alias("strict"))


SCORE_SQL = f"""sc0 AS (SELECT event_id, event_type, uid, slot, is_gt, {RS} AS s, {RE_} AS e, gt_s, gt_e, {FORMAT_LOOSE.format('response')} AS f FROM grounding),
sc AS (SELECT *, coalesce({iou_sql('s','e','gt_s','gt_e')}, 0.0) AS iou FROM sc0)"""


@query(f"WITH {SQL}, {SCORE_SQL} SELECT event_type, count(*) AS n, round(avg(iou), 6) AS iou_raw, round(avg({SHAPED.format('iou')}), 6) AS iou, CAST(sum(f) AS DOUBLE) AS format, round(avg({SHAPED.format('iou')} + 0.1 * f), 6) AS overall FROM sc GROUP BY event_type")
def m4_scored(spark, d):
    s = R.scored(grounding(spark, d), shaping=True)
    return s.groupBy("event_type").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("iou_raw", "iou", "overall")], F.sum("format").alias("format"))


@query(f"WITH {SQL}, {SCORE_SQL} SELECT event_id, round(CASE WHEN is_gt THEN least((iou + 0.1 * f) * 1.5, 0.6) ELSE iou + 0.1 * f END, 6) AS controlled FROM sc")
def m5_reference_control(spark, d):
    return R.controlled(R.scored(grounding(spark, d)), "overall", "is_gt", 1.5, 0.6).select("event_id", F.round("controlled", 6).alias("controlled"))


@query("SELECT DISTINCT rollout_id, CAST(response_length AS BIGINT) AS n, round(overall, 6) AS last, CAST(0 AS DOUBLE) AS first FROM reward_inputs WHERE response_length > 1 AND isfinite(overall)")
def m6_score_vector(spark, d):
    v = R.at_last_token(F.col("overall"), F.col("response_length"))
    return table(spark, d, "reward_inputs").where("response_length > 1 AND abs(overall) < 'Infinity'").select("rollout_id", F.size(v).cast("long").alias("n"), F.round(F.element_at(v, -1), 6).alias("last"), v[0].alias("first")).distinct()


@query(f"WITH {SQL}, {EVAL_SQL} SELECT event_id, CASE WHEN e_s IS NULL THEN duration + 10 ELSE round_even(e_s, 0) END AS s, CASE WHEN e_s IS NULL THEN duration + 20 ELSE round_even(e_e, 0) END AS e FROM evals")
def m7_prediction(spark, d):
    p = G.predicted(P.evaluated_span(F.col("response")), F.col("duration"))
    return grounding(spark, d).select("event_id", p["start"].alias("s"), p["end"].alias("e"))


@query(f"WITH {SQL}, {SCORE_SQL} SELECT event_id, round(iou, 6) AS reward FROM sc")
def m16_span_reward(spark, d):
    return grounding(spark, d).select("event_id", F.round(R.span_reward(F.col("response"), F.col("ground_truth")), 6).alias("reward"))


@query("SELECT row_id, CASE WHEN starts_with(preprocessed_video, '/data/') THEN '/mnt/root/' || substr(preprocessed_video, 7) WHEN starts_with(preprocessed_video, 'cache/') THEN '/mnt/root/' || substr(preprocessed_video, 7) ELSE '/mnt/root/' || preprocessed_video END AS path, split_part(preprocessed_video, '/', -1) AS base FROM records")
def proj_p2_p3_paths(spark, d):
    p = F.col("preprocessed_video")
    return table(spark, d, "records").select("row_id", P.rebased(p, ["/data/", "cache/"], "/mnt/root/").alias("path"), P.basename(p).alias("base"))


@query(f"WITH {SQL} SELECT event_id, '<answer> ' || CAST(gt_s AS BIGINT) || ' to ' || CAST(gt_e AS BIGINT) || ' </answer>' AS tagged, '{{\"time\":[' || CAST(gt_s AS BIGINT) || ',' || CAST(gt_e AS BIGINT) || ']}}' AS json FROM grounding")
def proj_p4_answer(spark, d):
    s = P.first_numbers(F.col("ground_truth"))
    a, b = s["start"].cast("long"), s["end"].cast("long")
    return grounding(spark, d).select("event_id", P.answer_text(a, b).alias("tagged"), P.answer_text(a, b, json=True).alias("json"))


@query("""WITH t AS (SELECT row_id, trim(replace(problem, '<video>', ''), ' ' || chr(10) || chr(9)) AS x FROM records),
u AS (SELECT row_id, x, regexp_extract(x, '(?i)(?:pinpoint|locate|find)\\s+(?:the\\s+)?(?:event|clip|moment)\\s+"([^"]+)"', 1) AS q, trim(regexp_replace(x, '(?is)\\s*(?:Provide the start|Please provide|Determine the precise).*$', ''), ' ' || chr(10) || chr(9)) AS c FROM t)
SELECT row_id, '<video>' || CASE WHEN q <> '' THEN q WHEN c <> '' THEN c ELSE x END AS question FROM u""")
def proj_p5_question(spark, d):
    return table(spark, d, "records").select("row_id", P.question(F.col("problem")).alias("question"))


@query("SELECT result_id, trim(regexp_replace(trim(regexp_replace(query, '\\s+', ' ', 'g')), '^\\.+|\\.+$', '', 'g')) AS query, count(*) AS copies FROM eval_results GROUP BY 1, 2")
def proj_p6_query(spark, d):
    return table(spark, d, "eval_results").select("result_id", P.levelled_query(F.col("query")).alias("query")).groupBy("result_id", "query").agg(F.count("*").alias("copies"))


@query("SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 20) || chr(10) || '... [truncated ' || (length(text) - 40) || ' chars] ...' || chr(10) || right(text, 20) END AS shown FROM documents")
def proj_p21_clipped(spark, d):
    return table(spark, d, "documents").select("doc_id", P.clipped(F.col("text"), 40).alias("shown"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'exp' || (user_id % 7) || '@' || (event_id % 90) END AS tag FROM events")
def proj_p22_run_tag(spark, d):
    path = F.expr("CASE WHEN event_id % 9 = 0 THEN 'runs/final/actor' ELSE 'runs/exp' || (user_id % 7) || '/global_step_' || (event_id % 90) || '/actor' END")
    return table(spark, d, "events").select("event_id", P.run_tag(path).alias("tag"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN event_id * 7 % 20000 END AS t, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE ELSE event_id / 8.0 END AS v FROM events)
SELECT event_id, CASE WHEN t IS NULL THEN 'n/a' WHEN t >= 3600 THEN (t // 3600) || 'h' || lpad(CAST(t % 3600 // 60 AS VARCHAR), 2, '0') || 'm' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') || 's' ELSE (t // 60) || 'm' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') || 's' END AS shown,
CASE WHEN v IS NULL OR isnan(v) THEN 'n/a' ELSE printf('%.3f', v) END AS metric FROM t""")
def proj_p23_duration(spark, d):
    """Durations and metrics as text, some of them missing or NaN."""
    e = F.col("event_id")
    seconds = F.when(e % 11 > 0, (e * 7 % 20000) + 0.25)
    value = F.when(e % 5 == 1, F.lit(float("nan"))).when(e % 5 > 1, e / 8)
    return table(spark, d, "events").select("event_id", P.duration_text(seconds).alias("shown"), P.metric_text(value, 3).alias("metric"))


@query("SELECT event_id, event_id % 3 < 2 AS scientific, CASE event_id % 3 WHEN 0 THEN event_id || '.0e-5' WHEN 1 THEN event_id || '.5E+3' ELSE CAST(round(event_id / 16.0, 3)::DOUBLE AS VARCHAR) END AS shown FROM events")
def x10_number_text(spark, d):
    """Numbers as a configuration file has them: with and without a decimal point, and plain ones of four decimals."""
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.concat(e.cast("string"), F.lit("e-5"))).when(e % 3 == 1, F.concat(e.cast("string"), F.lit(".5E+3"))).otherwise((e / 16).cast("string"))
    return table(spark, d, "events").select("event_id", P.scientific(text).alias("scientific"), P.configured_number(text).alias("shown"))


@query(f"WITH {BOXES_SQL} SELECT p_partkey, CAST(CASE WHEN p_partkey % 5 = 4 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS loose, CAST(CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS strict, CAST(0.0 AS DOUBLE) AS bare FROM boxes")
def f9_box_format(spark, d):
    """Boxes that can't be read, with words behind the block, with a second block, and bare."""
    k = F.col("p_partkey")
    said = F.when(k % 5 == 4, F.lit("no box 1, 2, three")).otherwise(F.col("said"))
    block = F.concat(F.when(k % 3 == 0, "<answer>none</answer> ").otherwise(""), F.lit("<answer>"), said, F.lit("</answer>"), F.when(k % 2 == 0, "").otherwise(" indeed"))
    return _boxes(spark, d).select("p_partkey", R.box_format(block).alias("loose"), R.box_format(block, True).alias("strict"), R.box_format(F.col("said")).alias("bare"))
