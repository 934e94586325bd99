"""Batch algebra, joins, intervals, crops and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import balance as L
from ..operators import batch as B
from ..operators import intervals as I
from ..operators.ranking import positions
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


def events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("pos"), "event_type", "value")


@query("SELECT event_id, event_type, value, NULL::BIGINT AS user_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, value, user_id FROM events WHERE event_id % 2 = 1")
def u1_concat(spark, d):
    e = table(spark, d, "events")
    return B.concatenated([e.where("event_id % 2 = 0").select("event_id", "event_type", "value"), e.where("event_id % 2 = 1").select("event_id", "value", "user_id")])


@query("SELECT CAST(event_id // ((SELECT count(*) FROM events) // 8) AS INTEGER) AS chunk, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def u2_chunks(spark, d):
    e = events(spark, d)
    return B.chunked(e, 8, e.count()).groupBy("chunk").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id, c AS copy, event_id * 3 + c AS aabb, c * n + event_id AS abab FROM events, n, range(0, 3) t(c)")
def u3_repeat(spark, d):
    e = events(spark, d).select("pos", F.col("pos").alias("event_id"))
    n = e.count()
    a = B.repeated(e, 3, True, n).select("event_id", F.col("copy").cast("long"), F.col("pos").alias("aabb"))
    b = B.repeated(e, 3, False, n).select("event_id", F.col("copy").cast("long"), F.col("pos").alias("abab"))
    return a.join(b, ["event_id", "copy"])


@query("WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id AS pos, event_type FROM events UNION ALL SELECT event_id + n, event_type FROM events, n WHERE event_id < (768 - n % 768) % 768")
def u4_pad(spark, d):
    e = events(spark, d).drop("value")
    return B.padded(e, 768, e.count())[0]


@query("SELECT (event_id * 7919) % (SELECT count(*) FROM events) AS pos, event_type, value FROM events")
def u5_reorder(spark, d):
    e = events(spark, d)
    n = e.count()
    return B.reordered(e, e.select("pos", ((F.col("pos") * 7919) % n).alias("new_pos")))


@query("SELECT CAST(event_id // ((SELECT count(*) FROM events) // 1000) AS INTEGER) AS chunk, round(list(value ORDER BY event_id)[2], 4) AS second, count(*) AS n FROM events GROUP BY 1")
def u6_fold(spark, d):
    e = events(spark, d)
    return B.folded(e, 1000, e.count(), "value").select("chunk", F.round(F.get("value", F.lit(1)), 4).alias("second"), F.size("value").cast("long").alias("n"))


@query("SELECT user_id, count(DISTINCT k) AS keys, count(v) AS filled, count(*) AS n FROM (SELECT user_id, event_type AS k, CASE WHEN event_type IN ('click', 'view') THEN value END AS v FROM events) q GROUP BY 1")
def u7_collate(spark, d):
    e = table(spark, d, "events")
    rows = B.concatenated([e.where("event_type IN ('click', 'view')").select("user_id", F.col("event_type").alias("k"), F.col("value").alias("v")), e.where("event_type NOT IN ('click', 'view')").select("user_id", F.col("event_type").alias("k"))])
    return rows.groupBy("user_id").agg(F.countDistinct("k").alias("keys"), F.count("v").alias("filled"), F.count("*").alias("n"))


@query("SELECT CAST(e AS INTEGER) AS epoch, CAST(event_id // 250 AS INTEGER) AS batch, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events, range(0, 2) t(e) GROUP BY 1, 2")
def u8_mini_batches(spark, d):
    e = events(spark, d)
    return B.mini_batches(e, 250, e.count(), 2).groupBy("epoch", "batch").agg(F.count("*").alias("n"), F.sum("pos").alias("total"))


@query("SELECT event_id AS pos, event_type, value, user_id * 2 AS twice FROM events")
def j2_union_by_position(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_id", "pos")
    return B.united(e.select("pos", "event_type", "value"), e.select("pos", "value", (F.col("user_id") * 2).alias("twice")), "pos")


@query("SELECT uid, slot, p.problem_id, o.rollout_id, CAST(o.response_length AS BIGINT) AS n FROM (SELECT uid, problem_id, CAST(unnest(range(0, rollout_n)) AS BIGINT) AS slot FROM (SELECT DISTINCT uid, problem_id, run_tag FROM reward_inputs) q JOIN runs USING (run_tag)) p FULL JOIN (SELECT uid, CAST(slot AS BIGINT) AS slot, rollout_id, response_length FROM reward_inputs) o USING (uid, slot)")
def j3_rollout_groups(spark, d):
    rows = table(spark, d, "reward_inputs")
    outs = rows.select("uid", F.col("slot").cast("long").alias("slot"), "rollout_id", F.col("response_length").cast("long").alias("n"))
    prompts = rows.select("uid", "problem_id", "run_tag").distinct().join(table(spark, d, "runs").select("run_tag", "rollout_n"), "run_tag").drop("run_tag")
    return B.rollout_joined(prompts, outs, "uid", "rollout_n").select("uid", "slot", "problem_id", "rollout_id", "n")


@query("SELECT coalesce(m.doc_id, b.doc_id) AS doc_id, coalesce(m.v, b.v) AS value, CASE WHEN m.doc_id IS NOT NULL THEN 'merged' ELSE 'base' END AS origin FROM (SELECT doc_id, min(subject) AS v FROM subject_labels GROUP BY 1) m FULL JOIN (SELECT doc_id, source AS v FROM documents) b ON m.doc_id = b.doc_id")
def j6_backfill(spark, d):
    merged = table(spark, d, "subject_labels").groupBy("doc_id").agg(F.min("subject").alias("value"))
    return B.backfilled(merged, table(spark, d, "documents").select("doc_id", F.col("source").alias("value")), "doc_id", "value")


@query("SELECT event_id, c AS copy FROM events, range(0, 2) t(c)")
def j9_repeat_align(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("pos"), "event_id")
    n = e.count()
    filled, added = B.padded(e, 768, n)
    return B.repeated(filled, 2, True, n + added).where(F.col("pos") < 2 * n).select("event_id", F.col("copy").cast("long").alias("copy"))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 64")
def q10_cut_batch(spark, d):
    return B.selected(table(spark, d, "documents"), ["doc_id", "source", "nothing"]).orderBy("doc_id").limit(64)


@query("SELECT doc_id AS id, lang AS language FROM documents")
def proj_p13_p15_columns(spark, d):
    picked, _ = B.popped(table(spark, d, "documents"), ["doc_id", "lang"])
    return B.renamed(picked, ["doc_id", "lang"], ["id", "language"])


SEGS = "seg AS (SELECT user_id, event_id % 500 AS a, event_id % 500 + event_id % 9 AS b FROM events)"


@query(f"""WITH {SEGS}, o AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT user_id, min(a) AS a, max(b) AS b FROM i GROUP BY user_id, g""")
def t2_merge_segments(spark, d):
    seg = table(spark, d, "events").select("user_id", (F.col("event_id") % 500).alias("a"), (F.col("event_id") % 500 + F.col("event_id") % 9).alias("b"))
    return I.merged(seg, "user_id")


KEYS = "kf AS (SELECT user_id, event_id % 400 AS frame, CAST(max(event_id * 13 % 301) AS DOUBLE) AS x FROM events GROUP BY 1, 2)"


@query(f"""WITH {KEYS}, nx AS (SELECT *, lead(frame) OVER w AS f1, lead(x) OVER w AS x1, row_number() OVER w AS n FROM kf WINDOW w AS (PARTITION BY user_id ORDER BY frame)), fr AS (SELECT user_id, f AS frame FROM (SELECT DISTINCT user_id FROM kf) q, range(0, 400) t(f)),
j AS (SELECT fr.user_id, fr.frame, nx.frame AS f0, nx.x AS x0, f1, x1 FROM fr JOIN nx ON fr.user_id = nx.user_id AND ((fr.frame >= nx.frame OR n = 1) AND (f1 IS NULL OR fr.frame < f1)))
SELECT user_id, frame, CASE WHEN f1 IS NULL OR frame <= f0 THEN x0 ELSE round_even(x0 + (x1 - x0) * ((frame - f0) / (f1 - f0)::DOUBLE), 0) END AS x FROM j""")
def t3_j7_densify(spark, d):
    k = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 400).alias("frame")).agg(F.max(F.col("event_id") * 13 % 301).cast("double").alias("x"))
    return I.densified(k, "user_id", 0, 399)


@query(f"WITH {SQL} SELECT event_id, CAST(greatest(0, least(199, round_even(gt_s * 2.5, 0))) AS INTEGER) AS a, CAST(greatest(0, least(199, round_even(gt_e * 2.5, 0))) AS INTEGER) AS b FROM grounding WHERE greatest(0, least(199, round_even(gt_e * 2.5, 0))) > greatest(0, least(199, round_even(gt_s * 2.5, 0)))")
def t1_frames(spark, d):
    f = G.frames(F.col("gt_s"), F.col("gt_e"), F.lit(2.5), F.lit(200))
    return grounding(spark, d).select("event_id", f.alias("f")).where("f IS NOT NULL").select("event_id", "f.a", "f.b")


@query(f"WITH {SEGS} SELECT DISTINCT user_id, a, b, f AS frame FROM seg, range(0, 600) t(f) WHERE f >= a AND f <= b AND ((f - a) % 4 = 0 OR f = b)")
def t4_keyframe_grid(spark, d):
    seg = table(spark, d, "events").select("user_id", (F.col("event_id") % 500).alias("a"), (F.col("event_id") % 500 + F.col("event_id") % 9).alias("b")).distinct()
    return I.keyframe_grid(seg, "a", "b", 4).select("user_id", "a", "b", F.explode("frames").alias("frame"))


RATIO = "(p_size * 20 + 100)::DOUBLE AS w, ((p_partkey % 50) * 10 + 100)::DOUBLE AS h, CASE WHEN p_partkey % 2 = 0 THEN 16.0::DOUBLE ELSE 9.0::DOUBLE END AS tw, CASE WHEN p_partkey % 2 = 0 THEN 9.0::DOUBLE ELSE 16.0::DOUBLE END AS th"
CROP = f"p AS (SELECT p_partkey, {RATIO} FROM part), c AS (SELECT *, CASE WHEN w / h >= tw / th THEN least(floor(h * tw / th), w) ELSE w END AS cw, CASE WHEN w / h >= tw / th THEN least(round_even(h * tw / th, 0), w) ELSE w END AS rw, CASE WHEN w / h >= tw / th THEN h ELSE least(round_even(w / (tw / th), 0), h) END AS rh FROM p)"


def parts(spark, d):
    even = F.col("p_partkey") % 2 == 0
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20 + 100).cast("double").alias("w"), ((F.col("p_partkey") % 50) * 10 + 100).cast("double").alias("h"), F.when(even, 16.0).otherwise(9.0).alias("tw"), F.when(even, 9.0).otherwise(16.0).alias("th"))


@query(f"WITH {CROP} SELECT p_partkey, cw, round(cw * th / tw, 6) AS ch, rw, rh FROM c")
def m8_crop_size(spark, d):
    cols = [F.col(c) for c in ("w", "h", "tw", "th")]
    a, b = G.crop_floor(*cols), G.crop_round(*cols)
    return parts(spark, d).select("p_partkey", a["w"].alias("cw"), F.round(a["h"], 6).alias("ch"), b["w"].alias("rw"), b["h"].alias("rh"))


@query(f"WITH {CROP}, e AS (SELECT *, cw * th / tw AS ch, (p_partkey % 11) / 10.0::DOUBLE AS cx, (p_partkey % 7) / 6.0::DOUBLE AS cy FROM c) SELECT p_partkey, round_even(greatest(0, least(cx * w - cw / 2, w - cw)), 0) AS x, floor(greatest(0, least(cy * h - ch / 2, h - ch))) AS y FROM e")
def m9_centred_box(spark, d):
    p = parts(spark, d)
    c = G.crop_floor(*[F.col(x) for x in ("w", "h", "tw", "th")])
    p = p.withColumn("cw", c["w"]).withColumn("ch", c["h"])
    b = G.centred_box((F.col("p_partkey") % 11) / 10.0, (F.col("p_partkey") % 7) / 6.0, *[F.col(x) for x in ("w", "h", "cw", "ch")])
    return p.select("p_partkey", b["x"].alias("x"), b["y"].alias("y"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(l_quantity + (l_partkey % 301 - l_quantity) * (l_linenumber / 7.0::DOUBLE), 0) AS BIGINT) AS x, count(*) AS n FROM lineitem GROUP BY ALL")
def m10_box_lerp(spark, d):
    x = G.lerp(F.col("l_quantity"), F.col("l_partkey") % 301, F.col("l_linenumber") / 7.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.alias("x")).groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x").agg(F.count("*").alias("n"))


@query(f"WITH {CROP} SELECT p_partkey, CAST(f AS BIGINT) AS frame, round_even((w - rw) / 2, 0) AS x, round_even((h - rh) / 2, 0) AS y, rw AS side FROM c, range(0, 24, 5) t(f)")
def t5_centre_crop(spark, d):
    c = G.centre_crops(*[F.col(x) for x in ("w", "h", "tw", "th")], F.lit(24).cast("long"), 5)
    return parts(spark, d).select("p_partkey", F.explode(c).alias("c")).select("p_partkey", "c.frame", "c.x", "c.y", F.col("c.w").alias("side"))


def doc_batches(spark, d):
    return table(spark, d, "documents").select(F.expr("doc_id div 128").alias("batch"), "doc_id", F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))


@query("SELECT doc_id // 128 AS batch, count(*) AS items, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS total, least(8, count(*)) AS parts, true AS even FROM documents GROUP BY 1")
def l1_differencing(spark, d):
    """Every item is in a part, all parts are used, and no two differ by more than the largest item."""
    b = L.balanced(doc_batches(spark, d), "batch", "doc_id", "n_chars", 8)
    per = b.groupBy("batch", "part").agg(F.count("*").alias("items"), F.sum("n_chars").alias("total"), F.max("n_chars").alias("largest"))
    spread = F.when(F.count("*") < 8, F.max("total")).otherwise(F.max("total") - F.min("total"))
    return per.groupBy("batch").agg(F.sum("items").alias("items"), F.sum("total").alias("total"), F.count("*").alias("parts"), (spread <= F.max("largest")).alias("even"))


@query()
def l1_parts(spark, d):
    b = L.balanced(doc_batches(spark, d), "batch", "doc_id", "n_chars", 8)
    return b.groupBy("batch", "part").agg(F.count("*").alias("items"), F.sum("n_chars").alias("total"))


ITEMS = "it AS (SELECT doc_id // 128 AS batch, doc_id, CAST(coalesce(n_chars, 0) AS BIGINT) AS n, row_number() OVER (PARTITION BY doc_id // 128 ORDER BY doc_id) AS i FROM documents)"


@query(f"""WITH RECURSIVE {ITEMS}, g AS (SELECT batch, CAST(0 AS BIGINT) AS i, [0,0,0,0,0,0,0,0]::BIGINT[] AS sums, [0,0,0,0,0,0,0,0]::BIGINT[] AS items FROM (SELECT DISTINCT batch FROM it) q UNION ALL
SELECT g.batch, it.i, list_transform(sums, lambda x, k: CASE WHEN k = list_position(sums, list_min(sums)) THEN x + it.n ELSE x END), list_transform(items, lambda x, k: CASE WHEN k = list_position(sums, list_min(sums)) THEN x + 1 ELSE x END) FROM g JOIN it ON it.batch = g.batch AND it.i = g.i + 1),
e AS (SELECT batch, arg_max(sums, i) AS sums, arg_max(items, i) AS items FROM g GROUP BY 1) SELECT batch, CAST(k AS INTEGER) AS part, items[k + 1] AS items, sums[k + 1] AS total FROM e, range(0, 8) t(k) WHERE items[k + 1] > 0""")
def l2_greedy(spark, d):
    return L.balanced(doc_batches(spark, d), "batch", "doc_id", "n_chars", 8, "greedy").groupBy("batch", "part").agg(F.count("*").alias("items"), F.sum("n_chars").alias("total"))


@query()
def l4_micro_batches(spark, d):
    return L.micro_batches(doc_batches(spark, d), "batch", "doc_id", "n_chars", 40_000)


@query("WITH b AS (SELECT doc_id // 128 AS batch, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) % 4 = 0) SELECT batch, doc_id, row_number() OVER (PARTITION BY batch ORDER BY doc_id) - 1 AS restored, n // 4 AS in_part FROM b JOIN documents ON doc_id // 128 = batch")
def l5_reordered(spark, d):
    """Documents put in the new order and back by the inverse order; parts are of equal count, so only batches that come out in four
    take part."""
    docs = doc_batches(spark, d)
    whole = docs.groupBy("batch").count().where("count % 4 = 0").select("batch")
    order = L.even_parts(docs.join(whole, "batch", "left_semi"), "batch", "doc_id", "n_chars", 4)
    moved = order.select("batch", F.col("new_pos").alias("pos"), "doc_id", "part")
    back = moved.join(order.select("batch", F.col("new_pos").alias("pos"), "old_pos"), ["batch", "pos"])
    sizes = order.groupBy("batch", "part").agg(F.count("*").alias("in_part"))
    return back.join(sizes, ["batch", "part"]).select("batch", "doc_id", F.col("old_pos").cast("long").alias("restored"), "in_part")


@query(f"""WITH {ITEMS}, m AS (SELECT batch, greatest(1, count(*) // 8) AS step FROM it GROUP BY 1), c AS (SELECT it.batch, (i - 1) // step AS c, CAST(sum(n) AS BIGINT) AS s FROM it JOIN m ON it.batch = m.batch GROUP BY 1, 2)
SELECT batch, CAST(min(s) AS BIGINT) AS min, CAST(max(s) AS BIGINT) AS max, CAST(max(s) - min(s) AS BIGINT) AS minmax_diff, round(sum(s) / 8.0, 4) AS mean, true AS no_wider, true AS around FROM c GROUP BY 1""")
def a12_imbalance(spark, d):
    """Balanced parts are never spread wider than stretches of rows, and lie around the mean."""
    i = L.imbalance(doc_batches(spark, d), "batch", "doc_id", "n_chars", 8)
    return i.select("batch", "min", "max", "minmax_diff", F.round("mean", 4).alias("mean"), (F.col("balanced_max") <= F.col("max")).alias("no_wider"), ((F.col("balanced_min") <= F.col("mean")) & (F.col("mean") <= F.col("balanced_max"))).alias("around"))


@query("""WITH RECURSIVE k AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, CAST(p_size AS BIGINT) * 1000000 AS n FROM part), r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS held UNION ALL
SELECT k.i, CASE WHEN held > 0 AND held + n > 200000000 THEN shard + 1 ELSE shard END, CASE WHEN held > 0 AND held + n > 200000000 THEN n ELSE held + n END FROM r JOIN k ON k.i = r.i + 1)
SELECT CAST(shard AS INTEGER) AS shard, CAST(sum(n) AS BIGINT) AS bytes, count(*) AS keys FROM r JOIN k ON k.i = r.i GROUP BY 1""")
def k7_shards(spark, d):
    sizes = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 1_000_000).cast("long").alias("bytes"))
    return L.shard_sizes(sizes, "p_partkey", "bytes", 200_000_000).groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("keys"))


@query("""SELECT 'missing' AS kind, doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 5 < 4 EXCEPT SELECT doc_id FROM subject_labels) a UNION ALL SELECT 'kept', doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 5 < 4 INTERSECT SELECT doc_id FROM subject_labels) b
UNION ALL SELECT 'extra', doc_id FROM (SELECT doc_id FROM subject_labels EXCEPT SELECT doc_id FROM documents WHERE doc_id % 5 < 4) c""")
def j5_key_sets(spark, d):
    """Keys that are missing, kept and extra; a fifth of the documents is not in the base."""
    docs, labels = table(spark, d, "documents").where("doc_id % 5 < 4"), table(spark, d, "subject_labels")
    out = None
    for kind, f in (("missing", B.missing_keys), ("kept", B.kept_keys), ("extra", B.extra_keys)):
        rows = f(docs, labels, "doc_id").select(F.lit(kind).alias("kind"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out


_A, _B = "SELECT user_id FROM events WHERE event_type = 'click' AND event_id % 50 = 1", "SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 20 = 0"


@query(f"SELECT 'both' AS kind, user_id FROM ({_A} INTERSECT {_B}) q UNION ALL SELECT 'either', user_id FROM ({_A} UNION {_B}) q UNION ALL SELECT 'first only', user_id FROM ({_A} EXCEPT {_B}) q")
def u10_key_sets(spark, d):
    e = table(spark, d, "events")
    a, b = e.where("event_type = 'click' AND event_id % 50 = 1").select("user_id"), e.where("event_type = 'error' AND event_id % 20 = 0").select("user_id")
    sets = {"both": a.intersect(b), "either": a.union(b).distinct(), "first only": a.exceptAll(a.join(b, "user_id", "left_semi")).distinct()}
    out = None
    for kind, rows in sets.items():
        rows = rows.select(F.lit(kind).alias("kind"), "user_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH n AS (SELECT count(*) AS n FROM events), i AS (SELECT k AS place, CASE WHEN k % 4 = 3 THEN -1 - k % 7 ELSE (k * k) % 500 END AS pos FROM range(0, 3000) t(k))
SELECT 'index' AS how, place, event_id FROM i, n JOIN events ON event_id = CASE WHEN pos < 0 THEN pos + n ELSE pos END UNION ALL SELECT 'slice', NULL, event_id FROM events WHERE event_id >= 10 AND event_id < 400 AND (event_id - 10) % 7 = 0
UNION ALL SELECT 'mask', NULL, event_id FROM events WHERE event_type = 'click' AND value > 50""")
def f10_selected(spark, d):
    """By a list of places with repeats and negative ones, by a slice, and by a mask."""
    e = table(spark, d, "events").select(F.col("event_id").alias("pos"), "event_id", "event_type", "value")
    k = F.col("id")
    index = spark.range(3000).select(k.alias("place"), F.when(k % 4 == 3, -1 - k % 7).otherwise((k * k) % 500).alias("pos"))
    none = F.lit(None).cast("long").alias("place")
    return (
        B.index_selected(e, index).select(F.lit("index").alias("how"), "place", "event_id")
        .unionByName(B.sliced(e, 10, 400, 7).select(F.lit("slice").alias("how"), none, "event_id"))
        .unionByName(B.masked(e, (F.col("event_type") == "click") & (F.col("value") > 50)).select(F.lit("mask").alias("how"), none, "event_id"))
    )


@query("WITH c AS (SELECT uid, min(problem) AS p FROM reward_inputs GROUP BY 1) SELECT r.rollout_id, upper(p) || length(p) AS computed, count(*) AS copies FROM reward_inputs r JOIN c ON r.uid = c.uid GROUP BY 1, 2")
def j8_computed_once(spark, d):
    """What is made of a group's prompt, made once."""
    r = table(spark, d, "reward_inputs")
    return B.computed_once(r, "uid", "problem", lambda p: F.concat(F.upper(p), F.length(p).cast("string"))).groupBy("rollout_id", "computed").agg(F.count("*").alias("copies"))


@query("SELECT user_id, list(event_id ORDER BY event_id) FILTER (event_id % 3 = 0) AS a, list(event_id * 2 ORDER BY event_id) AS b FROM events GROUP BY 1")
def m15_maps(spark, d):
    """Maps of two sources united, then their values appended by key."""
    e = F.col("event_id")
    first = F.when(e % 3 == 0, F.create_map(F.lit("a"), e)).otherwise(F.create_map(F.lit("b"), e * 2))
    rows = table(spark, d, "events").select("user_id", "event_id", B.united_maps(first, F.create_map(F.lit("b"), e * 2)).alias("m"))
    lists = B.appended(rows, "user_id", "m", "event_id")
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("values"))).alias(k)
    return lists.groupBy("user_id").agg(pick("a"), pick("b"))


@query("SELECT uid, list(slot ORDER BY slot, rollout_id) AS frames, list(rollout_id ORDER BY slot, rollout_id) AS ids FROM (SELECT DISTINCT uid, slot, rollout_id FROM reward_inputs) q GROUP BY 1")
def o14_sorted_predictions(spark, d):
    rows = B.sorted_predictions(table(spark, d, "reward_inputs").select("uid", "slot", "rollout_id").distinct(), "uid", "slot", ["rollout_id"])
    return rows.select("uid", F.transform("predictions", lambda x: x["slot"]).alias("frames"), F.transform("predictions", lambda x: x["rollout_id"]).alias("ids"))


@query("WITH n AS (SELECT count(*) AS n FROM events WHERE event_id < 700) SELECT k AS draw, CAST(k // n AS INTEGER) AS epoch, event_id, event_type FROM range(0, 2500) t(k), n JOIN events ON event_id = k % n")
def y10_restarted(spark, d):
    e = table(spark, d, "events").where("event_id < 700").select(F.col("event_id").alias("pos"), "event_id", "event_type")
    return B.restarted(e, e.count(), 2500).select("draw", "epoch", "event_id", "event_type")


@query("SELECT run_tag, rollout_id, slot FROM (SELECT run_tag, rollout_id, slot, row_number() OVER (PARTITION BY run_tag ORDER BY rollout_id, slot) AS n FROM reward_inputs) q WHERE n = 1")
def k9_one_sample(spark, d):
    return B.first_per(table(spark, d, "reward_inputs").select("run_tag", "rollout_id", "slot"), "run_tag", "rollout_id")


@query("""WITH it AS (SELECT doc_id // 128 AS batch, doc_id % 4 AS part, doc_id, CAST(coalesce(n_chars, 0) AS BIGINT) AS n FROM documents), p AS (SELECT batch, part, CAST(sum(n * n) AS BIGINT) AS work, min(doc_id) AS first FROM it GROUP BY 1, 2)
SELECT batch, part, work, CAST(row_number() OVER (PARTITION BY batch ORDER BY work DESC, first DESC) - 1 AS INTEGER) AS place FROM p""")
def o15_workloads(spark, d):
    """The micro-batches of a batch, most work first."""
    rows = doc_batches(spark, d).withColumn("part", F.col("doc_id") % 4)
    return L.by_work(rows, "batch", "part", "doc_id", "n_chars").select("batch", "part", "work", "place")
