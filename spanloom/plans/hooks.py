"""Plug-ins, dispatch, sinks, isolated jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import hooks as H
from ..operators import reward as R
from ..sources import records as J
from ..storage import materialise, scratch, table
from .grounding import SQL, grounding
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
    return scratch(spark, "hooks")


def batch_score(rows: list[dict]) -> list[float]:
    """A reward function over a batch."""
    return [round(r["iou"] + 0.1 * r["format"], 6) for r in rows]


def one_score(row: dict) -> float:
    """A reward function over one row."""
    return round(0.5 * row["iou"], 6)


@query(f"WITH {SQL}, {SCORE_SQL} SELECT event_id, round(iou + 0.1 * f, 6) AS batch, round(0.5 * iou, 6) AS single FROM sc")
def e1_reward_plugins(spark, d):
    """Users' functions by their specs, over batches and over single rows."""
    rows = R.scored(grounding(spark, d)).select("event_id", "iou", "format")
    a = H.scored_by(rows, H.load_function("spanloom.plans.hooks:batch_score"), "event_id", ["iou", "format"]).withColumnRenamed("score", "batch")
    b = H.scored_by(rows, H.load_function("spanloom.plans.hooks:one_score"), "event_id", ["iou"], "sequential").withColumnRenamed("score", "single")
    return a.join(b, "event_id").select("event_id", F.round("batch", 6).alias("batch"), F.round("single", 6).alias("single"))


def shown_truth(truth: str | None, extra: dict) -> str | None:
    """A builder in Python: nothing for some kinds of events."""
    return None if truth is None or extra["event_type"] == "error" else f"{extra['event_type']}: {truth}"


def plain_truth(truth, extra):
    """A builder in expressions."""
    return F.when(extra["event_type"] != "error", F.concat(extra["event_type"], F.lit(": "), truth))


plain_truth.columns = True


@query(f"WITH {SQL} SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type || ': ' || ground_truth END AS built, CASE WHEN event_type <> 'error' THEN event_type || ': ' || ground_truth END AS column_built FROM grounding")
def e2_truth_builders(spark, d):
    g = grounding(spark, d).select("event_id", "event_type", "ground_truth")
    g = H.ground_truths(g, shown_truth, "ground_truth", ["event_type"])
    return H.ground_truths(g, plain_truth, "ground_truth", ["event_type"], "column_built").select("event_id", "built", "column_built")


def _halves(df, ranks):
    """A way of dispatch of one's own: rows in turn."""
    return df.withColumn("rank", (F.col("pos") % ranks).cast("int"))


def _rank_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"n": [len(pdf)], "first": [int(pdf["pos"].iloc[0])], "total": [int(pdf["pos"].sum())]})


_SUMS = "count(*) AS n, CAST(min(event_id) AS BIGINT) AS first, CAST(sum(event_id) AS BIGINT) AS total FROM e"


@query(f"WITH e AS (SELECT event_id FROM events WHERE event_id < (SELECT count(*) FROM events) // 4 * 4), n AS (SELECT count(*) AS n FROM e) SELECT 'one_to_all' AS mode, CAST(r AS INTEGER) AS rank, {_SUMS}, range(0, 4) t(r) GROUP BY r UNION ALL "
       f"SELECT 'stretches', CAST(event_id // ((SELECT n FROM n) // 4) AS INTEGER), {_SUMS} GROUP BY 2 UNION ALL SELECT 'first_of_all', 0, {_SUMS} UNION ALL SELECT 'own', CAST(event_id % 4 AS INTEGER), {_SUMS} GROUP BY 2 UNION ALL SELECT 'all_to_all', CAST(event_id % 3 AS INTEGER), {_SUMS} GROUP BY 2")
def l6_e4_dispatch(spark, d):
    """Every way of dispatch, one of the user's own among them."""
    e = table(spark, d, "events").select(F.col("event_id").alias("pos"))
    n = e.count() // 4 * 4
    e = e.where(F.col("pos") < n)
    given = {"one_to_all": e, "stretches": e, "first_of_all": e, "all_to_all": e.withColumn("rank", (F.col("pos") % 3).cast("int"))}
    out = None
    for mode, rows in [*given.items(), ("own", e)]:
        way = (_halves, lambda x: x) if mode == "own" else mode
        made = H.dispatched(rows, way, 4, _rank_sums, "n long, first long, total long").select(F.lit(mode).alias("mode"), "rank", "n", "first", "total")
        out = made if out is None else out.unionByName(made)
    return out


@query("SELECT event_id, upper(event_type) AS shouted FROM events")
def e5_executed(spark, d):
    def shout(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": pdf["event_id"], "shouted": pdf["event_type"].str.upper()})
    return H.executed(table(spark, d, "events").select("event_id", "event_type"), shout, "event_id long, shouted string")


_MEANS = f"WITH {SQL}, m AS (SELECT event_type AS metric, round(avg(score), 6) AS value FROM grounding GROUP BY 1), s AS (SELECT metric, value + i AS value, i + 7 AS step FROM m, range(0, 2) t(i))"


@query(f"{_MEANS} SELECT sink, metric, round(value, 6) AS value, CAST(step AS INTEGER) AS step FROM s, (VALUES ('lines'), ('table')) AS k(sink)")
def k5_e7_sinks(spark, d):
    """Two steps of metrics to two registered sinks of one run, read back."""
    m = materialise(grounding(spark, d).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("score"), 6).alias("value")), "metrics")
    place = _place(spark)
    for i in range(2):
        H.tracked(m.select("metric", (F.col("value") + i).alias("value")), ["lines", "table"], place, 7 + i)
    back = [spark.read.schema("metric string, value double, step int").json(f"{place}/lines"), spark.read.schema("metric string, value double, step int").parquet(f"{place}/table")]
    return back[0].withColumn("sink", F.lit("lines")).unionByName(back[1].withColumn("sink", F.lit("table"))).select("sink", "metric", F.round("value", 6).alias("value"), "step")


@query(f"WITH {SQL} SELECT '[prompt] ' || event_type || chr(10) || '[output] ' || coalesce(response, '') || chr(10) || '[label] ' || coalesce(ground_truth, '') || chr(10) || '[score] ' || event_id || CASE WHEN event_type = 'click' THEN chr(10) || '[problem_id] ' || event_id ELSE '' END AS block FROM grounding")
def k6_sample_blocks(spark, d):
    """Samples with and without a problem's id, written as blocks of text and read back."""
    g = grounding(spark, d).select("event_type", F.col("event_type").alias("prompt"), F.col("response").alias("output"), F.col("ground_truth").alias("label"), F.col("event_id").alias("score"), F.col("event_id").alias("problem_id"))
    place, end = _place(spark), "\n\n====\n\n"
    for name, rows in (("four", g.where("event_type <> 'click'").drop("problem_id")), ("five", g.where("event_type = 'click'"))):
        rows.select(H.sample_blocks(rows).alias("value")).write.option("lineSep", end).text(f"{place}/{name}")
    return spark.read.option("lineSep", end).text([f"{place}/four", f"{place}/five"]).select(F.col("value").alias("block"))


@query("SELECT row_id, preprocessed_video IS NOT NULL AS prepared, problem FROM records")
def k2_split_sink(spark, d):
    """Rows with a prepared video in one sink, the others beside it, read back."""
    place = _place(spark) + ".jsonl"
    J.write_split(table(spark, d, "records").select("row_id", "preprocessed_video", "problem"), "preprocessed_video IS NOT NULL", place)
    schema = "row_id long, preprocessed_video string, problem string"
    good, bad = J.lines(spark, place, schema), J.lines(spark, place + ".failed", schema)
    return good.select("row_id", F.lit(True).alias("prepared"), "problem").unionByName(bad.select("row_id", F.lit(False).alias("prepared"), "problem"))


@query("SELECT event_type AS job, count(*) AS n, CASE WHEN event_type = 'error' THEN true ELSE false END AS failed FROM events WHERE event_type <> 'error' GROUP BY 1 UNION ALL SELECT 'error', 0, true")
def y9_isolated(spark, d):
    """A job per type of event; one fails and is left out of the merge alone."""
    e = table(spark, d, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().limit(1000).collect()]  # types of events, a handful

    def job(kind):
        bad = F.when(F.lit(kind) == "error", F.raise_error(F.lit("this one fails")).cast("long")).otherwise(F.col("event_id"))
        return lambda: materialise(e.where(F.col("event_type") == kind).select(bad.alias("x")).agg(F.count("x").alias("n")).select(F.lit(kind).alias("job"), "n", F.lit(False).alias("failed")), "job")

    done, failed = H.isolated({k: job(k) for k in sorted({*kinds, "error"})})
    out = spark.createDataFrame([(k, 0, True) for k in failed], "job string, n long, failed boolean")
    for part in done.values():
        out = out.unionByName(part)
    return out


@query("SELECT 'timing/' || s AS metric, true AS took FROM (VALUES ('all'), ('gen')) AS t(s)")
def a20_timed(spark, d):
    held: dict[str, float] = {}
    with H.timed("all", held):
        for _ in range(2):
            with H.timed("gen", held):
                table(spark, d, "runs").count()
    return H.timings(spark, held).select("metric", ((F.col("value") > 0) & (F.col("value") <= held["all"])).alias("took"))


@query("SELECT row_id, CASE row_id % 4 WHEN 0 THEN 'pkg.mod' WHEN 1 THEN 'plain.py' WHEN 2 THEN '/a:b/f.py' ELSE 'C:/x.py' END AS \"where\", CASE row_id % 4 WHEN 0 THEN 'run' || row_id WHEN 1 THEN 'main' WHEN 2 THEN 'main' ELSE 'go' END AS name FROM records")
def x11_function_spec(spark, d):
    k = F.col("row_id") % 4
    spec = F.when(k == 0, F.concat(F.lit("pkg.mod:run"), F.col("row_id").cast("string"))).when(k == 1, "plain.py").when(k == 2, "/a:b/f.py").otherwise("C:/x.py:go")
    return table(spark, d, "records").select("row_id", H.function_spec(spec).alias("s")).select("row_id", "s.*")
