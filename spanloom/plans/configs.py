"""Configurations, checks of runs, layouts of saves: one row per configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import configs as C
from ..storage import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


def parts(spark, d, *columns):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), *columns)


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS least, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 END AS image, CASE WHEN p_partkey % 3 = 0 THEN p_size + 2 END AS video, CASE WHEN p_partkey % 5 = 0 THEN p_size + 3 END AS val FROM part)
SELECT id, coalesce(image, least) AS image_min, coalesce(video, image, least) AS video_min, coalesce(val, video, image, least) AS val_min FROM p""")
def c1_cascade(spark, d):
    """Defaults that reach through several names."""
    k, n = F.col("p_partkey"), F.col("p_size")
    df = parts(spark, d, n.alias("least"), F.when(k % 2 == 0, n + 1).alias("image_min"), F.when(k % 3 == 0, n + 2).alias("video_min"), F.when(k % 5 == 0, n + 3).alias("val_min"))
    return C.completed(df, [("image_min", "least"), ("video_min", "image_min"), ("val_min", "video_min")]).drop("least")


@query("SELECT p_partkey AS id, CASE WHEN p_brand LIKE '%3' THEN 99 ELSE p_size END AS eos, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE CASE WHEN p_brand LIKE '%3' THEN 99 ELSE p_size END END AS pad FROM part")
def c2_special_tokens(spark, d):
    s = C.special_tokens(F.col("p_brand"), F.col("p_size").cast("long"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")), {"3": 99})
    rows = table(spark, d, "part").withColumn("p_brand", F.substring("p_brand", -1, 1))
    return rows.select(F.col("p_partkey").alias("id"), s.alias("s")).select("id", "s.eos", "s.pad")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 5 AS micro, 4 * (p_size % 4 + 1) AS mini, 8 * (p_partkey % 7 + 1) AS roll, CASE p_partkey % 3 WHEN 0 THEN 'grpo' WHEN 1 THEN 'gae' ELSE 'rloo' END AS est, p_size % 3 AS n, p_partkey % 2 = 0 AS inj, p_size % 6 - 1 AS rep, p_partkey % 4 = 0 AS lp, p_partkey % 9 AS epochs, CASE WHEN p_partkey % 10 = 0 THEN p_size END AS most FROM part)
SELECT id, list_filter([CASE WHEN micro = 0 OR mini % micro <> 0 THEN 'mini_batch is no multiple of micro_batch' END, CASE WHEN roll % mini <> 0 THEN 'rollout_batch is no multiple of mini_batch' END, CASE WHEN est IN ('grpo', 'rloo') AND n <= 1 THEN 'the estimator needs groups' END,
CASE WHEN inj AND lp THEN 'injected answers have no log-probs of the rollout' END, CASE WHEN inj AND (rep < -1 OR rep > n - 1) THEN 'replaced slot out of range' END], lambda x: x IS NOT NULL) AS faults, CAST(coalesce(most, 1000 // roll * epochs) AS BIGINT) AS steps FROM p""")
def c3_run_faults(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    df = parts(spark, d, (k % 5).alias("micro_batch"), (4 * (n % 4 + 1)).alias("mini_batch"), (8 * (k % 7 + 1)).alias("rollout_batch"), F.when(k % 3 == 0, "grpo").when(k % 3 == 1, "gae").otherwise("rloo").alias("estimator"),
               (n % 3).alias("n"), (k % 2 == 0).alias("inject"), (n % 6 - 1).alias("replace"), (k % 4 == 0).alias("log_probs"), (k % 9).alias("epochs"), F.when(k % 10 == 0, n).alias("most"))
    return df.select("id", C.run_faults().alias("faults"), C.training_steps(F.lit(1000), F.col("rollout_batch"), F.col("epochs"), F.col("most")).alias("steps"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS size, p_partkey % 8 + 1 AS n, p_partkey % 5 * 8 + 1 AS dev, p_partkey % 3 + 1 AS micro FROM part)
SELECT id, CAST(size * n AS BIGINT) AS whole, CAST(size * n // dev AS BIGINT) AS per_device, CASE WHEN size * n // dev = 0 THEN 'nothing is left per device' WHEN (size * n // dev) % micro <> 0 THEN 'no multiple of the micro-batch' END AS fault FROM p""")
def c4_scaled(spark, d):
    k = F.col("p_partkey")
    return parts(spark, d, C.scaled(F.col("p_size"), k % 8 + 1, k % 5 * 8 + 1, k % 3 + 1).alias("s")).select("id", "s.*")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS temperature, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 8 END::DOUBLE AS n, CAST(2 AS INTEGER) AS names, CAST(8 AS DOUBLE) AS before FROM part")
def c5_scoped_override(spark, d):
    """Known parameters are replaced, unknown ones ignored, and the given ones stay."""
    k = F.col("p_partkey")
    params = F.create_map(F.lit("n"), F.lit(8.0), F.lit("temperature"), F.lit(1.0))
    asked = F.map_concat(F.create_map(F.lit("nothing"), F.lit(3.0)), F.when(k % 2 == 0, F.create_map(F.lit("temperature"), F.lit(0.5))).otherwise(F.create_map().cast("map<string,double>")), F.when(k % 3 == 0, F.create_map(F.lit("n"), F.col("p_size").cast("double"))).otherwise(F.create_map().cast("map<string,double>")))
    made = parts(spark, d, params.alias("p"), C.overridden(params, asked).alias("m"))
    return made.select("id", F.col("m")["temperature"].alias("temperature"), F.col("m")["n"].alias("n"), F.size("m").alias("names"), F.col("p")["n"].alias("before"))


@query("SELECT row_id, CASE WHEN row_id % 3 = 0 THEN '/data/a' || (row_id % 40) END AS found, CASE WHEN row_id % 3 = 1 THEN 'no checkpoint at /none/a' || (row_id % 40) END AS message FROM records")
def c6_existing_path(spark, d):
    """Paths that are listed, relative ones among them, that are not, and NULL."""
    r = F.col("row_id")
    name = F.concat(F.lit("a"), (r % 40).cast("string"))
    listing = spark.range(40).select(F.concat(F.lit("/data/a"), F.col("id").cast("string")).alias("file"))
    rows = table(spark, d, "records").select("row_id", F.when(r % 3 == 0, F.concat(F.when(r % 2 == 0, "/data/").otherwise("data/"), name)).when(r % 3 == 1, F.concat(F.lit("/none/"), name)).alias("p"))
    return C.existing(rows, listing, "p", "checkpoint").select("row_id", "found", "message")


@query("SELECT p_partkey AS step, 14 AS wanted, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 14 END AS missing FROM part")
def c7_save_layout(spark, d):
    """Saves of four ranks: whole ones, ones without optimizer, and ones that were never written."""
    steps = parts(spark, d).withColumnRenamed("id", "step")
    layout = C.save_layout(steps, 4)
    listing = layout.where((F.col("step") % 3 == 0) | ((F.col("step") % 3 == 1) & ~F.col("path").contains("/optim_"))).select("path")
    return C.restorable(layout, listing).select("step", F.col("wanted").cast("int").alias("wanted"), F.col("missing").cast("int").alias("missing"))


@query("SELECT p_partkey AS id, p_partkey % 7 <> 0 AND (p_partkey % 7) * 2000000000.0 <= 9000000000.0 AS fits FROM part")
def f12_model_size(spark, d):
    return parts(spark, d, C.within_size((F.col("p_partkey") % 7) * 2e9).alias("fits"))


@query("SELECT user_id, user_id % 4 = 0 OR max(event_id) >= 150 * (user_id % 100) AS rebuild FROM events GROUP BY 1")
def y7_stale(spark, d):
    """Derived files that are missing, older, as old and newer than the newest of their sources."""
    sources = table(spark, d, "events").select("user_id", F.col("event_id").alias("mtime"))
    derived = sources.select("user_id").distinct().where("user_id % 4 <> 0").select("user_id", (150 * (F.col("user_id") % 100)).cast("long").alias("mtime"))
    return C.stale(derived, sources, "user_id")
