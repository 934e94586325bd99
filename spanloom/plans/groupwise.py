"""Group-relative statistics, losses and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import sequences as S
from ..operators import groups as G
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


W = "OVER (PARTITION BY uid)"


@query(f"WITH {SQL} SELECT event_id, round((score - avg(score) {W}) / (stddev_samp(score) {W} + 1e-6), 4) + 0.0 AS advantage FROM grounding")
def g1_grpo(spark, d):
    return G.advantages("grpo", grounding(spark, d)).select("event_id", F.round("advantage", 4).alias("advantage"))


@query(f"""WITH {SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, slot) AS n, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, slot) AS second, stddev_samp(score) {W} AS sd FROM grounding)
SELECT event_id, round(CASE WHEN n = 1 THEN (score - second) / (sd + 1e-6) ELSE 0.0 END, 4) AS advantage FROM r""")
def g2_grpo_passk(spark, d):
    return G.advantages("grpo_passk", grounding(spark, d)).select("event_id", F.round("advantage", 4).alias("advantage"))


@query(f"WITH {SQL} SELECT event_id, round(score - (sum(score) {W} - score) / (count(*) {W} - 1), 4) AS advantage FROM grounding")
def g3_rloo(spark, d):
    return G.advantages("rloo", grounding(spark, d)).select("event_id", F.round("advantage", 4).alias("advantage"))


def sequences(spark, d):
    """Per group the eight slots as a sequence: rewards, values, log-probs and a prefix mask."""
    g = grounding(spark, d)
    rows = g.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("slot", "score", "k", "event_id"))).alias("s"))
    return rows.select(
        "uid", F.transform("s", lambda x: x["score"]).alias("rewards"), F.transform("s", lambda x: x["k"] / 10.0).alias("values"),
        F.transform("s", lambda x: -(x["k"] % 13) / 13.0 - 0.05).alias("new"), F.transform("s", lambda x: -(x["k"] % 17) / 17.0 - 0.05).alias("old"),
        F.transform("s", lambda x: (x["k"] - 50) / 50.0).alias("adv"), F.transform("s", lambda x: F.when(x["slot"] <= F.col("uid") % 8, 1.0).otherwise(0.0)).alias("mask"),
        F.transform("s", lambda x: x["k"] % 10).alias("tokens"), F.lit(1.5).alias("baseline"),
    )


SEQ = f"""{SQL}, tok AS (SELECT uid, slot, score AS r, k / 10.0::DOUBLE AS v, -(k % 13) / 13.0::DOUBLE - 0.05 AS pn, -(k % 17) / 17.0::DOUBLE - 0.05 AS po, (k - 50) / 50.0::DOUBLE AS a,
  CASE WHEN slot <= uid % 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m, k % 10 AS token FROM grounding)"""


def exploded(df, *arrays, places=4):
    """One row per position: uid, slot and the arrays' items, rounded."""
    return df.select("uid", F.posexplode(F.arrays_zip(*[F.col(a) for a in arrays])).alias("slot", "x")).select("uid", F.col("slot").cast("long").alias("slot"), *[F.round(F.col(f"x.{a}"), places).alias(a) for a in arrays])


# behind a masked position the run starts anew, so a return reaches no further than the last unmasked one
REINFORCE = """g AS (SELECT a.uid, a.slot, a.m, sum(b.r * power(0.9, b.slot - a.slot)) AS ret FROM tok a JOIN tok b ON a.uid = b.uid AND b.slot >= a.slot AND (b.slot = a.slot OR b.slot <= a.uid % 8) GROUP BY 1, 2, 3),
mo AS (SELECT sum(ret * m) / (sum(m) + 1e-8) AS mu, sum(m) AS n FROM g), va AS (SELECT sum((ret - mu) * (ret - mu) * m) / (sum(m) + 1e-8) * max(n) / (max(n) - 1) AS var FROM g, mo)"""


@query(f"WITH {SEQ}, {REINFORCE} SELECT uid, slot, round(ret, 10) AS returns, round((ret - mu) / sqrt(var + 1e-8), 10) AS advantages FROM g, mo, va")
def g4_reinforce_plus_plus(spark, d):
    return exploded(G.advantages("reinforce_plus_plus", sequences(spark, d), gamma=0.9), "returns", "advantages", places=10)


@query(f"""WITH {SEQ}, t AS (SELECT uid, sum(r) AS total FROM tok GROUP BY uid)
SELECT tok.uid, tok.slot, round((total - 1.5) * m, 4) AS advantages, round(sum(r * m) OVER (PARTITION BY tok.uid ORDER BY slot DESC), 4) AS returns FROM tok JOIN t ON tok.uid = t.uid""")
def g5_remax(spark, d):
    return exploded(G.advantages("remax", sequences(spark, d)), "advantages", "returns")


GAE = """nx AS (SELECT uid, slot, r, v, m, coalesce(lead(v * m) OVER (PARTITION BY uid ORDER BY slot), 0) AS nv FROM tok),
de AS (SELECT uid, slot, v, m, (r + 0.95 * nv - v) * m AS delta FROM nx),
ga AS (SELECT a.uid, a.slot, a.v, a.m, CASE WHEN a.m = 1 THEN sum(b.delta * power(0.95 * 0.9, b.slot - a.slot)) ELSE 0 END AS g FROM de a JOIN de b ON a.uid = b.uid AND b.slot >= a.slot GROUP BY 1, 2, 3, 4),
mo AS (SELECT sum(g * m) / (sum(m) + 1e-8) AS mu, sum(m) AS n FROM ga),
va AS (SELECT sum((g - mu) * (g - mu) * m) / (sum(m) + 1e-8) * max(n) / (max(n) - 1) AS var FROM ga, mo)"""


@query(f"WITH {SEQ}, {GAE} SELECT uid, slot, round((g - mu) / sqrt(var + 1e-8), 10) AS advantages, round(g + v, 10) AS returns FROM ga, mo, va")
def g6_gae(spark, d):
    return exploded(G.advantages("gae", sequences(spark, d), gamma=0.95, lam=0.9), "advantages", "returns", places=10)


@query(f"""WITH {SQL}, w AS (SELECT event_id, uid, score, avg(score) {W} AS mu, stddev_samp(score) {W} + 1e-6 AS sd, sum(score) {W} AS total, count(*) {W} AS n, row_number() OVER (PARTITION BY uid ORDER BY score DESC, slot) AS r, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, slot) AS second FROM grounding)
SELECT name, event_id, round(CASE name WHEN 'grpo' THEN (score - mu) / sd WHEN 'rloo' THEN score - (total - score) / (n - 1) ELSE CASE WHEN r = 1 THEN (score - second) / sd ELSE 0.0 END END, 4) + 0.0 AS advantage FROM (SELECT * FROM w, (VALUES ('grpo'), ('rloo'), ('grpo_passk')) AS k(name)) q""")
def g7_estimators(spark, d):
    """The estimators of scalar scores, each called by its name; those of sequences are g4 to g6."""
    g = grounding(spark, d)
    out = None
    for name in ("grpo", "rloo", "grpo_passk"):
        rows = G.advantages(name, g).select(F.lit(name).alias("name"), "event_id", F.round("advantage", 4).alias("advantage"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {SEQ} SELECT uid, slot, round(pn - po, 4) AS kl, round(abs(pn - po), 4) AS abs, round(0.5 * (pn - po) * (pn - po), 4) AS mse,
round(greatest(-10.0, least(10.0, exp(greatest(-20.0, least(20.0, po - pn))) - greatest(-20.0, least(20.0, po - pn)) - 1)), 4) AS low_var_kl FROM tok""")
def g8_kl(spark, d):
    s = sequences(spark, d)
    kinds = ["kl", "abs", "mse", "low_var_kl"]
    return exploded(s.select("uid", *[S.kl(F.col("new"), F.col("old"), k).alias(k) for k in kinds]), *kinds)


@query(f"WITH {SEQ}, p AS (SELECT uid, sum((pn - po) * m) / (sum(m) + 1e-8) AS mean FROM tok GROUP BY uid) SELECT tok.uid, slot, round(r - 0.01 * (pn - po) * m, 4) AS reward, round(mean, 4) AS mean_kl FROM tok JOIN p ON tok.uid = p.uid")
def g9_penalised(spark, d):
    s = sequences(spark, d).withColumn("kl", S.kl(F.col("new"), F.col("old"), "kl"))
    s = s.withColumn("mean_kl", S.masked_mean(F.col("kl"), F.col("mask"))).withColumn("pen", F.zip_with("kl", "mask", lambda k, m: 0.01 * k * m))
    s = s.withColumn("reward", F.zip_with("rewards", "pen", lambda r, p: r - p)).withColumn("mean_kl", F.transform("reward", lambda _: F.col("mean_kl")))
    return exploded(s, "reward", "mean_kl")


STEPS = "steps AS (SELECT event_id // 100 AS step, avg(value) AS metric, avg(value) / 400 AS kl, CAST(count(*) AS DOUBLE) AS n_steps FROM events GROUP BY 1)"


def steps(spark, d):
    return table(spark, d, "events").groupBy(F.expr("event_id div 100").alias("step")).agg(F.avg("value").alias("metric"), (F.avg("value") / 400).alias("kl"), F.count("*").cast("double").alias("n_steps"))


@query(f"WITH {STEPS} SELECT step, round(0.05 * exp(sum(ln(1 + greatest(-0.2, least(0.2, kl / 0.03 - 1)) * n_steps / 10000.0)) OVER (ORDER BY step)), 6) AS coefficient FROM steps")
def g10_adaptive_kl(spark, d):
    return G.adaptive_coefficient(steps(spark, d), 0.05, 0.03, 10000.0).select("step", F.round("coefficient", 6).alias("coefficient"))


def _policy(kind: str):
    def run(spark, d):
        t = S.policy_terms(sequences(spark, d), "old", "new", "adv", "mask", 0.2, 0.3, 3.0, kind)
        return t.agg(F.round(S.loss(t, "loss", "mask", "token"), 6).alias("token_loss"), F.round(S.loss(t, "loss", "mask", "seq"), 6).alias("seq_loss"),
                     F.round(S.loss(t, "clip_high", "mask", "token"), 6).alias("clip_high"), F.round(S.loss(t, "clip_low", "mask", "token"), 6).alias("clip_low"), F.round(S.loss(t, "kl", "mask", "token"), 6).alias("ppo_kl"))
    return run


POLICY = f"""WITH {SEQ}, mean AS (SELECT uid, sum((pn - po) * m) / (sum(m) + 1e-8) AS mk FROM tok GROUP BY uid),
q AS (SELECT tok.*, pn - po AS dd, {{ratio}} AS lr FROM tok JOIN mean ON tok.uid = mean.uid),
c AS (SELECT *, -a * exp(greatest(-20.0, least(20.0, lr))) AS l1, exp(greatest(ln(0.8), least(ln(1.3), lr))) AS cl FROM q),
e AS (SELECT *, greatest(l1, -a * cl) AS up FROM c),
f AS (SELECT uid, m, dd, {{loss}} AS loss, {{high}} AS hi, {{low}} AS lo FROM e),
s AS (SELECT avg(x) AS sl FROM (SELECT uid, sum(loss * m) / (sum(m) + 1e-8) AS x FROM f GROUP BY uid))
SELECT round(sum(loss * m) / (sum(m) + 1e-8), 6) AS token_loss, round(max(sl), 6) AS seq_loss, round(sum(hi * m) / (sum(m) + 1e-8), 6) AS clip_high, round(sum(lo * m) / (sum(m) + 1e-8), 6) AS clip_low, round(-sum(dd * m) / (sum(m) + 1e-8), 6) AS ppo_kl FROM f, s"""
DUAL = {"loss": "CASE WHEN a < 0 THEN least(up, -a * 3.0) ELSE up END", "high": "CASE WHEN l1 < -a * cl THEN 1.0 ELSE 0.0 END", "low": "CASE WHEN up > -a * 3.0 AND a < 0 THEN 1.0 ELSE 0.0 END"}
for _kind, _ratio in (("default", "pn - po"), ("gspo", "mk * m"), ("gspo_token", "mk"), ("cispo", "pn - po")):
    _terms = {"loss": "-a * pn * cl", "high": "0.0", "low": "0.0"} if _kind == "cispo" else DUAL
    QUERIES[f"g11_policy_{_kind}"] = _policy(_kind)
    ORACLE_SQL[f"g11_policy_{_kind}"] = POLICY.format(ratio=_ratio, **_terms)


@query(f"""WITH {SEQ}, l AS (SELECT uid, m, v AS p, (v - r) * (v - r) AS a, (greatest(pn - 0.5, least(pn + 0.5, v)) - r) * (greatest(pn - 0.5, least(pn + 0.5, v)) - r) AS b FROM tok)
SELECT round(0.5 * sum(greatest(a, b) * m) / (sum(m) + 1e-8), 6) AS vf_loss, round(sum(CASE WHEN a < b THEN m ELSE 0 END) / (sum(m) + 1e-8), 6) AS clip, round(sum(p * m) / (sum(m) + 1e-8), 6) AS vpred_mean FROM l""")
def g12_value_loss(spark, d):
    s = S.value_terms(sequences(spark, d), "values", "rewards", "new", 0.5)
    return s.agg(F.round(0.5 * S.loss(s, "vf_most", "mask", "token"), 6).alias("vf_loss"), F.round(S.loss(s, "vf_clipped", "mask", "token"), 6).alias("clip"), F.round(S.loss(s, "values", "mask", "token"), 6).alias("vpred_mean"))


@query(f"""WITH {STEPS}, t AS (SELECT step, avg(metric) OVER w AS sm, count(*) OVER w AS n FROM steps WINDOW w AS (ORDER BY step ROWS 4 PRECEDING)), u AS (SELECT step, CASE WHEN n = 5 AND step >= 8 THEN sm END AS sm FROM t),
v AS (SELECT *, max(sm) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM u) SELECT step, round(sm, 6) AS smoothed FROM v WHERE sm IS NOT NULL AND (best IS NULL OR sm > best)""")
def g13_smoothed_best(spark, d):
    return G.smoothed_best(steps(spark, d), 5, 8).select("step", F.round("smoothed", 6).alias("smoothed"))


@query(f"WITH {STEPS}, v AS (SELECT step, metric, max(metric) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM steps WHERE step % 5 = 0) SELECT step, round(metric, 6) AS best FROM v WHERE metric > coalesce(best, -1)")
def g14_best_validation(spark, d):
    return G.smoothed_best(steps(spark, d).where("step % 5 = 0").where("metric > -1"), 1, 0).select("step", F.round("metric", 6).alias("best"))


@query(f"WITH {STEPS} SELECT step, round(avg(metric) OVER (ORDER BY step) * (1000 - step), 4) AS left_s FROM steps")
def g15_time_left(spark, d):
    return G.time_left(steps(spark, d), "step", "metric", 1000).select("step", F.round("left", 4).alias("left_s"))


@query("SELECT s AS step, round(least(1.0, s / 20.0), 6) AS constant, round(CASE WHEN s < 20 THEN 0.1 + 0.9 * s / 20.0 ELSE greatest(0.05, cos(pi() * (s - 20) / 180.0) * 0.475 + 0.525) END, 6) AS cosine FROM range(0, 201) t(s)")
def g16_learning_rates(spark, d):
    s = F.col("id")
    return spark.range(0, 201).select(s.alias("step"), F.round(G.learning_rate(s, 20, 200), 6).alias("constant"), F.round(G.learning_rate(s, 20, 200, "cosine", 0.1, 0.05), 6).alias("cosine"))


@query(f"""WITH {SQL}, w AS (SELECT *, (score - avg(score) {W}) / (stddev_samp(score) {W} + 1e-6) AS adv, avg(score) {W} AS mu, stddev_pop(score) {W} AS sd, avg(score) FILTER (NOT is_gt) {W} AS muo, stddev_pop(score) FILTER (NOT is_gt) {W} AS sdo FROM grounding),
x AS (SELECT *, (score - mu) / (sd + 1e-6) AS base FROM w),
p AS (SELECT uid, any_value(mu) AS mu, any_value(sd) AS sd, any_value(muo) AS muo, any_value(sdo) AS sdo, count(*) FILTER (NOT is_gt AND ((adv > 0 AND base < 0) OR (adv < 0 AND base > 0))) AS flips, count(*) FILTER (NOT is_gt) AS ops, max(base) FILTER (NOT is_gt) AS best,
  sum(abs(adv)) FILTER (NOT is_gt AND adv > 0) AS pos, count(*) FILTER (NOT is_gt AND adv > 0) AS npos, sum(abs(adv)) FILTER (NOT is_gt AND adv < 0) AS neg, count(*) FILTER (NOT is_gt AND adv < 0) AS nneg, sum(abs(adv)) FILTER (is_gt) AS gt, count(*) FILTER (is_gt) AS ngt, max(abs(adv)) FILTER (is_gt) AS gtmax FROM x GROUP BY uid),
m AS (SELECT avg(muo) AS mu_op_mean, avg(mu) AS mu_g_mean, avg(sdo) AS sigma_op_mean, avg(sd) AS sigma_g_mean, coalesce(avg(CASE WHEN sdo >= 1e-3 THEN sd / sdo END), 0) AS sigma_ratio_per_group, avg(sd) / avg(sdo) AS sigma_ratio_of_means,
  coalesce(avg(CASE WHEN sdo >= 1e-3 THEN abs(mu - muo) / sdo END), 0) AS contamination_per_group, abs(avg(mu) - avg(muo)) / avg(sdo) AS contamination_of_means, CAST(count(*) FILTER (sdo < 1e-3) AS DOUBLE) AS degenerate_op_groups,
  CAST(sum(flips) AS DOUBLE) AS sign_flip_count, CAST(sum(flips) AS DOUBLE) / CAST(sum(ops) AS DOUBLE) AS sign_flip_rate, CAST(count(*) FILTER (best <= 0) AS DOUBLE) AS groups_with_no_op_pos_baseline, CAST(count(*) AS DOUBLE) AS n_groups,
  sum(gt) / CAST(sum(ngt) AS DOUBLE) AS gt_adv_mag_mean, max(gtmax) AS gt_adv_mag_max, sum(pos) / CAST(sum(npos) AS DOUBLE) AS op_adv_pos_mean, CAST(sum(npos) AS DOUBLE) AS op_adv_pos_count, sum(neg) / CAST(sum(nneg) AS DOUBLE) AS op_adv_neg_mean, CAST(sum(nneg) AS DOUBLE) AS op_adv_neg_count FROM p)
SELECT metric, round(value, 4) AS value FROM (UNPIVOT m ON * INTO NAME metric VALUE value)""")
def a9_injection_diagnostics(spark, d):
    return G.injection_diagnostics(G.advantages("grpo", grounding(spark, d))).select("metric", F.round("value", 4).alias("value"))


@query(f"WITH {SQL} SELECT event_id, slot = 7 AND event_type <> 'error' AS is_gt_row, CASE WHEN slot = 7 AND event_type <> 'error' THEN '<answer> ' || CAST(gt_s AS BIGINT) || '.00 to ' || CAST(gt_e AS BIGINT) || '.00 </answer>' ELSE response END AS response FROM grounding")
def j4_injection(spark, d):
    g = grounding(spark, d)
    ref = g.where("slot = 7").select("uid", F.when(F.col("event_type") != "error", P.reference_response(F.col("ground_truth"))).alias("reference"))
    return G.injected(g, ref, 8).select("event_id", "is_gt_row", "response")


@query(f"WITH {SEQ}, f AS (SELECT uid, min(slot) FILTER (token IN (3, 7)) AS stop FROM tok GROUP BY uid) SELECT tok.uid, slot, CAST(CASE WHEN stop IS NULL OR slot <= stop THEN 1 ELSE 0 END AS INTEGER) AS mask FROM tok JOIN f ON tok.uid = f.uid")
def q1_response_mask(spark, d):
    s = sequences(spark, d).withColumn("m", S.response_mask(F.col("tokens"), [3, 7]))
    return s.select("uid", F.posexplode("m").alias("slot", "mask")).select("uid", F.col("slot").cast("long").alias("slot"), F.col("mask"))


@query(f"WITH {SEQ}, c AS (SELECT uid, CAST(uid % 8 + 1 AS INTEGER) AS n, list(token ORDER BY slot) AS t FROM tok GROUP BY uid) SELECT uid, n, t[n] AS last_kept, t[greatest(1, n - 3)] AS left_cut, CAST(CASE WHEN n < 6 THEN 6 - n ELSE 0 END AS INTEGER) AS pads FROM c")
def q2_pad_and_cut(spark, d):
    own = F.slice("tokens", 1, (F.col("uid") % 8 + 1).cast("int"))
    s = sequences(spark, d).select("uid", own.alias("t"))
    p = S.padded(F.col("t"), 6, -1)
    return s.select("uid", F.size("t").alias("n"), F.element_at("t", -1).alias("last_kept"), S.truncated(F.col("t"), 4, "left")[0].alias("left_cut"), F.size(F.filter(p, lambda x: x == -1)).alias("pads"))


@query(f"WITH {SEQ} SELECT a.uid, a.slot, round(sum(b.r * power(0.9, b.slot - a.slot)), 10) AS returns FROM tok a JOIN tok b ON a.uid = b.uid AND b.slot >= a.slot GROUP BY 1, 2")
def q3_backward_scan(spark, d):
    return exploded(sequences(spark, d).withColumn("returns", S.to_go(F.col("rewards"), 0.9)), "returns", places=10)


@query(f"WITH {SEQ} SELECT uid, slot, CAST(greatest(0, sum(m) OVER (PARTITION BY uid ORDER BY slot) - 1) AS INTEGER) AS position FROM tok")
def q4_position_ids(spark, d):
    s = sequences(spark, d).select("uid", F.posexplode(S.position_ids(F.col("mask"))).alias("slot", "position"))
    return s.select("uid", F.col("slot").cast("long").alias("slot"), "position")


@query(f"WITH {SEQ}, s AS (SELECT uid, slot, lead(slot, 1, 8) OVER (PARTITION BY uid ORDER BY slot) - slot AS n FROM tok WHERE token = 0 OR slot = 0) SELECT uid, slot, n FROM s")
def q7_packed_lengths(spark, d):
    s = sequences(spark, d).select("uid", F.explode(S.packed_lengths(F.col("tokens"))).alias("x"))
    return s.select("uid", F.col("x.at").cast("long").alias("slot"), F.col("x.length").cast("long").alias("n"))


@query(f"WITH {SEQ} SELECT uid, CAST(slot // 3 AS INTEGER) AS rank, CAST(sum(token) AS BIGINT) AS total FROM tok GROUP BY 1, 2")
def q8_pad_and_slice(spark, d):
    s = sequences(spark, d).select("uid", F.explode(S.rank_slices(F.col("tokens"), 3, 0)).alias("x"))
    return s.select("uid", "x.rank", F.aggregate("x.part", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"WITH {SEQ} SELECT round(sum(r * m) / (sum(m) + 1e-8), 6) AS mean, round((sum(r * r * m) / sum(m) - power(sum(r * m) / sum(m), 2)) * sum(m) / (sum(m) - 1), 4) AS var FROM tok")
def a10_masked_moments(spark, d):
    mean, var = S.batch_moments(sequences(spark, d), "rewards", "mask")
    return spark.createDataFrame([(round(mean, 6), round(var, 4))], "mean double, var double")


@query(f"WITH {SEQ}, p AS (SELECT uid, sum(r * m) / (sum(m) + 1e-8) AS x FROM tok GROUP BY uid), q AS (SELECT avg(x) AS s FROM p) SELECT round(sum(r * m) / (sum(m) + 1e-8), 6) AS token, round(max(s), 6) AS seq FROM tok, q")
def a11_loss_modes(spark, d):
    s = sequences(spark, d)
    return s.agg(F.round(S.loss(s, "rewards", "mask", "token"), 6).alias("token"), F.round(S.loss(s, "rewards", "mask", "seq"), 6).alias("seq"))


@query(f"WITH {SEQ}, c AS (SELECT uid, list(token ORDER BY slot) FILTER (m = 1) AS kept, list(CASE WHEN m = 1 THEN token ELSE -1 END ORDER BY slot) AS back, list(token ORDER BY slot) AS t FROM tok GROUP BY uid) SELECT uid, kept, back, list_concat(t[2:], t[:1]) AS labels FROM c")
def q6_unpad(spark, d):
    """Out of the padding, back into it, and the labels, which are the next tokens."""
    kept = S.unpadded(F.col("tokens"), F.col("mask"))
    return sequences(spark, d).select("uid", kept.alias("kept"), S.padded_back(kept, F.col("mask"), -1).alias("back"), S.rolled(F.col("tokens")).alias("labels"))


MISSING = "(token = 3 AND uid % 31 = 0)"


@query(f"WITH {SEQ} SELECT uid, list(CASE WHEN slot > 7 THEN 0.0 WHEN {MISSING} THEN round(po, 4) ELSE round(pn, 4) END ORDER BY slot) AS log_probs FROM (SELECT uid, slot, token, pn, po FROM tok UNION ALL SELECT DISTINCT uid, place, 0, 0.0, 0.0 FROM tok, range(8, 10) t(place)) q GROUP BY uid")
def q9_chosen_log_probs(spark, d):
    """Tables of several tokens per place, few without the chosen one; padded to ten places."""
    rows = F.arrays_zip(F.col("tokens").alias("t"), F.col("new").alias("n"), F.col("old").alias("o"))
    lost = lambda x: (x["t"] == 3) & (F.col("uid") % 31 == 0)
    other = lambda x: F.create_map((x["t"] + 1) % 10, x["o"])
    tables = F.transform(rows, lambda x: F.when(lost(x), other(x)).otherwise(F.map_concat(other(x), F.create_map(x["t"], x["n"]))))
    s = S.checked_log_probs(sequences(spark, d).withColumn("tables", tables), "tokens", "tables", 10)
    return s.select("uid", F.transform("log_probs", lambda x: F.round(x, 4)).alias("log_probs"))
