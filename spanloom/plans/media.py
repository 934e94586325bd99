"""Sources of images and videos, their metadata, and prompts with media in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import media as M
from ..operators import prompts as Q
from ..storage import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN 'bytes' WHEN p_partkey % 8 = 3 THEN 'path' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'jpeg' END AS format,
CAST(CASE WHEN p_partkey % 4 < 2 THEN p_size * 20 + 100 END AS INTEGER) AS w, CAST(CASE WHEN p_partkey % 4 < 2 THEN p_partkey % 5000 + 1 END AS INTEGER) AS h FROM part""")
def s9_images(spark, d):
    """Images as bytes of a PNG, GIF or JPEG file, as a path, or not at all."""
    w, h = F.col("p_size") * 20 + 100, F.col("p_partkey") % 5000 + 1
    long4 = lambda c: F.lpad(F.hex(c), 8, "0")
    low2 = lambda c: F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256)), 2, "0"))
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), long4(w), long4(h))).when(k == 1, F.concat(F.lit("474946383961"), low2(w), low2(h))).when(k == 2, F.lit("FFD8FFE000104A46"))
    path = F.when(F.col("p_partkey") % 8 == 3, F.lit("a/b.png")).when(F.col("p_partkey") % 8 == 7, F.lit(" "))
    return table(spark, d, "part").select("p_partkey", M.image_source(path, F.unhex(text)).alias("s")).select("p_partkey", "s.*")


@query("SELECT p_partkey, p_partkey % 900 AS frames, CASE WHEN p_size % 5 > 1 THEN CAST(p_size % 5 AS DOUBLE) ELSE 25.0 END AS fps, CAST(p_size AS INTEGER) AS w, round((p_partkey % 900) / CASE WHEN p_size % 5 > 1 THEN CAST(p_size % 5 AS DOUBLE) ELSE 25.0 END, 6) AS duration FROM part")
def s10_metadata(spark, d):
    """The rate is missing, NaN, 0 or negative for some videos."""
    k = F.col("p_size") % 5
    fps = F.when(k > 1, k.cast("double")).when(k == 1, F.when(F.col("p_partkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(-1.0))).when(F.col("p_partkey") % 2 == 0, F.lit(0.0))
    m = M.video_metadata(F.col("p_partkey") % 900, fps, F.col("p_size"), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", m.alias("m")).select("p_partkey", "m.frames", "m.fps", F.col("m.w").cast("int").alias("w"), F.round("m.duration", 6).alias("duration"))


@query("SELECT row_id, CASE WHEN starts_with(videos[1], '/') THEN videos[1] ELSE '/data/' || videos[1] END AS path FROM records")
def s18_paths(spark, d):
    return table(spark, d, "records").select("row_id", Q.rooted(F.get("videos", F.lit(0)), "/data").alias("path"))


def _samples(spark, d):
    """Samples that state their videos in each of the ways, and the listing of files: every other one has metadata of its own."""
    r = F.col("row_id")
    name = lambda k: F.concat(F.lit("f"), (k % 10).cast("string"))
    meta = F.struct(F.lit(4.0).alias("fps"), (r % 5 + 1).cast("int").alias("total"), F.array(F.lit(0)).alias("indices"))
    none = F.lit(None).cast(M.METADATA)
    k = r % 7
    video = F.when(k < 3, F.struct(
        F.when(k == 0, "inline").when(k == 1, "preprocessed").otherwise("path").alias("source_type"),
        F.when(k > 0, F.when(k == 1, F.array(name(r))).otherwise(F.array(name(r), name(r + 1)))).alias("paths"),
        F.when(k == 0, F.array((r % 5 + 1).cast("int"), F.lit(7), F.lit(8))).alias("frames"), F.when(k == 0, F.array(meta, none)).alias("metadatas")))
    rows = table(spark, d, "records").select(
        "row_id", video.alias("video"), F.when(k == 3, F.array(F.lit(9), F.lit(3))).alias("tensors"), F.when((k == 3) & (r % 2 == 0), F.array(meta, none)).alias("video_metadatas"),
        F.when(k == 4, name(r)).alias("preprocessed_video_path"), F.when(k == 5, F.array(name(r))).alias("videos"))
    n = (F.col("id") * 3 + 2).cast("int")
    files = spark.range(10).select(name(F.col("id")).alias("path"), n.alias("frames"), F.when(F.col("id") % 2 == 0, F.struct(F.lit(5.0).alias("fps"), n.alias("total"), F.array(F.lit(0)).alias("indices"))).alias("metadata"))
    return rows, files


@query("""WITH f AS (SELECT 'f' || i AS path, CAST(i * 3 + 2 AS INTEGER) AS frames, CASE WHEN i % 2 = 0 THEN 5.0 ELSE 2.0 END AS fps FROM range(0, 10) t(i)),
e AS (SELECT row_id, 0 AS nth, 'inline' AS origin, NULL AS path, row_id % 5 + 1 AS frames, 4.0 AS fps FROM records WHERE row_id % 7 = 0 UNION ALL SELECT row_id, 1, 'inline', NULL, 7, 2.0 FROM records WHERE row_id % 7 = 0
UNION ALL SELECT row_id, 0, 'preprocessed', 'f' || (row_id % 10), NULL, NULL FROM records WHERE row_id % 7 IN (1, 4) UNION ALL SELECT row_id, 0, 'path', 'f' || (row_id % 10), NULL, NULL FROM records WHERE row_id % 7 IN (2, 5)
UNION ALL SELECT row_id, 1, 'path', 'f' || ((row_id + 1) % 10), NULL, NULL FROM records WHERE row_id % 7 = 2 UNION ALL SELECT row_id, 0, 'given', NULL, 9, CASE WHEN row_id % 2 = 0 THEN 4.0 END FROM records WHERE row_id % 7 = 3
UNION ALL SELECT row_id, 1, 'given', NULL, 3, NULL FROM records WHERE row_id % 7 = 3)
SELECT row_id, CAST(nth AS INTEGER) AS "at", origin, e.path, CAST(coalesce(e.frames, f.frames) AS INTEGER) AS frames, CAST(coalesce(e.fps, f.fps) AS DOUBLE) AS fps FROM e LEFT JOIN f ON e.path = f.path""")
def s14_s15_resolved(spark, d):
    return M.resolved(*_samples(spark, d), "row_id").select("row_id", "at", "origin", "path", "frames", F.col("metadata.fps").alias("fps"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'image' WHEN event_id % 3 = 0 THEN 'none' ELSE 'video' END AS media, CASE WHEN event_id % 5 = 0 OR event_id % 3 > 0 THEN event_id % 7 + 1 END AS n FROM events")
def f13_media(spark, d):
    """Images go before videos; the number of metadata, told from an array of its own, must be that of the frames."""
    from ..operators.dispatch import resolved_media
    e = F.col("event_id")
    frames = F.when(e % 3 > 0, F.array_repeat(F.lit(1), (e % 7 + 1).cast("int")))
    metadata = F.when(e % 3 > 0, F.transform(F.sequence(F.lit(1), (e % 7 + 1).cast("int")), lambda i: F.struct(i.alias("at"))))
    images = F.when(e % 5 == 0, e % 7 + 1)
    media = resolved_media(F.when(e % 3 > 0, F.size(frames)), F.when(e % 3 > 0, F.size(metadata)), images)
    return table(spark, d, "events").select("event_id", media.alias("media"), F.coalesce(images, F.when(e % 3 > 0, F.size(frames))).cast("long").alias("n"))


@query("""WITH r AS (SELECT row_id, CASE row_id % 3 WHEN 0 THEN replace(problem, '<video>', '<image>') ELSE problem END AS problem, CASE row_id % 3 WHEN 0 THEN '<image>' WHEN 1 THEN '<video>' END AS mark FROM records),
s AS (SELECT row_id, mark, CASE WHEN mark IS NULL THEN [problem] ELSE string_split(problem, mark) END AS p FROM r),
e AS (SELECT row_id, 2 * i - 1 AS o, CASE mark WHEN '<image>' THEN 'image' ELSE 'video' END AS type, NULL AS text FROM s, range(1, 20) t(i) WHERE i < len(p) UNION ALL SELECT row_id, 2 * i, 'text', p[i + 1] FROM s, range(0, 20) t(i) WHERE i < len(p) AND (p[i + 1] <> '' OR mark IS NULL))
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY o) - 1 AS INTEGER) AS at, type, text FROM e""")
def proj_p11_parts(spark, d):
    """Samples with images, with videos, and with neither."""
    k = F.col("row_id") % 3
    text = F.when(k == 0, F.replace("problem", F.lit("<video>"), F.lit("<image>"))).otherwise(F.col("problem"))
    one = F.array(F.lit("x"))
    parts = M.contents(text, F.when(k == 0, one), F.when(k == 1, one))
    return table(spark, d, "records").where("problem IS NOT NULL").select("row_id", F.posexplode(parts).alias("at", "x")).select("row_id", "at", "x.type", "x.text")


@query("""WITH r AS (SELECT row_id, problem, CASE row_id % 6 WHEN 0 THEN 'multiple choice' WHEN 1 THEN 'segmentation' WHEN 2 THEN 'segmentation' WHEN 3 THEN 'tracking' WHEN 4 THEN 'unheard of' END AS kind, row_id % 4 AS o FROM records)
SELECT row_id, 'Q: ' || problem || CASE WHEN kind = 'multiple choice' AND o > 1 THEN chr(10) || 'Options:' || chr(10) || 'A. yes' || chr(10) || 'B. no' ELSE '' END || chr(10) || CASE WHEN kind = 'multiple choice' THEN 'Give a letter.' WHEN kind = 'tracking' THEN 'Give boxes.' WHEN kind = 'segmentation' AND row_id % 6 = 1 THEN 'Mark each frame.' WHEN kind = 'segmentation' THEN 'Mark the image.' ELSE '' END AS prompt FROM r""")
def proj_p9_prompt(spark, d):
    """Options present, empty and missing; both kinds of segmentation; an unknown type and none."""
    t = spark.createDataFrame([("multiple choice", "Give a letter."), ("tracking", "Give boxes."), ("segmentation_video", "Mark each frame."), ("segmentation_image", "Mark the image.")], "problem_type string, tail string")
    k, o = F.col("row_id") % 6, F.col("row_id") % 4
    rows = table(spark, d, "records").select(
        "row_id", "problem", F.when(k == 0, "multiple choice").when(k.isin(1, 2), "segmentation").when(k == 3, "tracking").when(k == 4, "unheard of").alias("problem_type"),
        F.when(k == 1, " Video ").otherwise("image").alias("data_type"), F.when(o > 1, F.array(F.lit("A. yes"), F.lit("B. no"))).when(o == 1, F.array().cast("array<string>")).alias("options"))
    return Q.built(rows, t, ("Q: ", "\n")).select("row_id", "prompt")


@query("SELECT doc_id, trim(coalesce(CASE WHEN doc_id % 3 > 0 THEN text END, source), ' ' || chr(9) || chr(10) || chr(13)) AS content FROM documents")
def proj_p10_template(spark, d):
    problem = F.when(F.col("doc_id") % 3 > 0, F.col("text"))
    return table(spark, d, "documents").select("doc_id", Q.passed_through(problem, F.col("source")).alias("content"))


@query("SELECT row_id, '[' || coalesce(source, '') || '] ' || problem || CASE WHEN has_offline_trajectory THEN ' (given)' ELSE '' END || ' / ' || coalesce(CAST(row_id AS VARCHAR), '') AS prompt FROM records")
def e6_row_template(spark, d):
    """A template text with the row's fields in scope; a conditional part is a field made before."""
    rows = table(spark, d, "records").withColumn("tail", F.when(F.col("has_offline_trajectory"), " (given)"))
    return rows.select("row_id", Q.filled("[{source}] {problem}{tail} / {row_id}", rows).alias("prompt"))


@query("SELECT row_id, len(string_split(problem, ' ')) <= 30 AS kept, length(problem) <= 200 AS by_characters FROM records")
def f6_overlong(spark, d):
    """Two tokenizers: blanks, and characters."""
    rows = table(spark, d, "records").select("row_id", "problem")
    words = Q.within_length(rows, "problem", 30, lambda c: F.size(F.split(c, " ")), "kept")
    return Q.within_length(words, "problem", 200, F.length, "by_characters").drop("problem")


@query("SELECT DISTINCT ON (rollout_id) rollout_id, response, coalesce(response_length, 0) AS response_length, ground_truth, problem_type, data_type, NULL::VARCHAR AS problem_id, NULL::VARCHAR AS extra FROM reward_inputs ORDER BY rollout_id")
def proj_p12_reward_input(spark, d):
    rows = table(spark, d, "reward_inputs").dropDuplicates(["rollout_id"]).drop("problem_id", "prompt", "problem")
    made = Q.reward_inputs(rows, ["ground_truth", "problem_type", "data_type", "problem_id", "extra"])
    return rows.select("rollout_id", made.alias("x")).select("rollout_id", "x.*")


@query("SELECT p_partkey, 'a' || p_partkey || '.pt' AS path, p_partkey % 4 AS frames, CAST(2.0 AS DOUBLE) AS fps, CAST(p_partkey % 4 AS INTEGER) AS listed, 'v2' AS version FROM part")
def k8_artifact_records(spark, d):
    n = F.col("p_partkey") % 4
    r = M.artifact_record(F.concat(F.lit("a"), F.col("p_partkey").cast("string"), F.lit(".pt")), n, F.lit(1.0), "v2")
    return table(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.path", "r.frames", "r.metadata.fps", F.size("r.metadata.indices").alias("listed"), "r.version")
