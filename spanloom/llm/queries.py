"""The queries of the problems, by name; each takes (spark, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, table
from . import cross_split, defects, grouped_splits, packing, proportions, subjects, tokens
from .records import problem_type_name, split_name, valid_rows, video_ids


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The sample, and the cells that it was drawn from."""
    rows = valid_rows(table(spark, d, "records"), difficulty=F.col("difficulty"), duration=F.col("duration"))
    return proportions.proportional_sample(rows, table(spark, d, "sample_plans"), table(spark, d, "sample_targets"))


def p1_sample(spark, d):
    return _p1(spark, d)[0]


def p1_report(spark, d):
    return proportions.sampling_report(*_p1(spark, d))


def p1_found(spark, d):
    return p1_report(spark, d).where("short").select("plan_id", "category")


def _p2(spark: SparkSession, d: str) -> DataFrame:
    return valid_rows(
        table(spark, d, "records"), split=split_name(F.col("split")), source=F.col("source"), problem=F.col("problem"),
        entities=video_ids(F.col("videos")),
    )


def p2_found(spark, d):
    pair = (F.col("evaluation_id"), F.col("training_id"))
    return cross_split.overlaps(_p2(spark, d)).select(F.least(*pair).alias("record_id_a"), F.greatest(*pair).alias("record_id_b"))


def p2_report(spark, d):
    """Per evaluation split and source: evaluation records, those with an overlap, pairs."""
    rows = materialise(_p2(spark, d), "p2-records")
    per = cross_split.overlaps(rows).groupBy(F.col("evaluation_id").alias("record_id")).agg(F.count("*").alias("pairs"))
    return (
        rows.where("split IN ('val', 'test')").select("record_id", "split", "source").join(per, "record_id", "left")
        .groupBy("split", "source").agg(
            F.count("*").alias("evaluation_records"), F.count("pairs").alias("overlapping_records"),
            F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    )


def _p3(spark: SparkSession, d: str) -> DataFrame:
    rows = valid_rows(
        table(spark, d, "records"), problem_type=problem_type_name(F.col("problem_type")), entities=video_ids(F.col("videos"))
    )
    return grouped_splits.grouped(materialise(rows, "p3-records"), "record_id", "entities")


def p3_found(spark, d):
    return grouped_splits.groups_of_several(_p3(spark, d), "record_id")


def p3_splits(spark, d):
    return grouped_splits.assign_splits(_p3(spark, d), table(spark, d, "split_targets"))


def p3_shares(spark, d):
    rows = materialise(_p3(spark, d), "p3-grouped")
    made = grouped_splits.assign_splits(rows, table(spark, d, "split_targets")).select("record_id", "split")
    counts = made.join(rows.select("record_id", "problem_type"), "record_id").groupBy("problem_type", "split").agg(F.count("*").alias("records"))
    whole = counts.groupBy("problem_type").agg(F.sum("records").alias("of"))
    return counts.join(whole, "problem_type").select("problem_type", "split", "records", F.round(F.col("records") / F.col("of"), 4).alias("share"))


def p4_found(spark, d):
    return defects.defective_fields(table(spark, d, "reward_inputs"), table(spark, d, "runs"), problem_type_name(F.col("problem_type")))


def p4_by_run(spark, d):
    """Cases per run, field and defect."""
    runs = table(spark, d, "reward_inputs").groupBy("rollout_id").agg(F.min("run_tag").alias("run_tag"))
    return p4_found(spark, d).join(runs, "rollout_id").groupBy("run_tag", "field", "defect").agg(F.count("*").alias("cases"))


def p5_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"))


def p5_roundtrip(spark, d):
    """Documents by whether decoding gives their text back."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = tokens.decode(tokens.encode(docs)).withColumnRenamed("text", "back")
    same = F.coalesce("text", F.lit("")) == F.col("back")
    return docs.join(back, "doc_id").groupBy(same.alias("same")).agg(F.count("*").alias("documents"))


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.sizes(table(spark, d, "documents")), table(spark, d, "pack_plans"))


def p6_containers(spark, d):
    return _p6(spark, d)


def p6_found(spark, d):
    return _p6(spark, d).where("pieces > 1").select("plan_id", "doc_id").distinct()


def p6_report(spark, d):
    return packing.report(_p6(spark, d), table(spark, d, "pack_plans"))


def _p7(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p7_found(spark, d):
    return _p7(spark, d).select("doc_id", "subject")


def p7_makeup(spark, d):
    """Documents, and sentences about the subject, by source and subject."""
    return (
        _p7(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "subject")
        .agg(F.count("*").alias("documents"), F.round(F.sum("sentences"), 0).cast("long").alias("sentences"))
    )


QUERIES = {
    "p7_found": p7_found,
    "p7_makeup": p7_makeup,
    "p5_ids": p5_ids,
    "p5_roundtrip": p5_roundtrip,
    "p6_found": p6_found,
    "p6_containers": p6_containers,
    "p6_report": p6_report,
    "p4_found": p4_found,
    "p4_by_run": p4_by_run,
    "p1_found": p1_found,
    "p1_sample": p1_sample,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_splits": p3_splits,
    "p3_shares": p3_shares,
}

#: Where SQL can state a result over whole tables; the rest is tested against brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "p1_found": """WITH last AS (SELECT r.record_id, any_value(r.difficulty) AS d, any_value(r.duration) AS t FROM records r JOIN (SELECT record_id, max(ingested_at) AS m FROM records GROUP BY 1) x ON r.record_id = x.record_id AND r.ingested_at = x.m GROUP BY 1),
pool AS (SELECT * FROM last WHERE isfinite(d) AND isfinite(t) AND d BETWEEN 0 AND 1 AND t > 0),
cells AS (SELECT g.plan_id, g.category, g.weight, g.min_keep, count(p.record_id) AS n FROM sample_targets g LEFT JOIN pool p ON (difficulty_lo IS NULL OR d >= difficulty_lo) AND (difficulty_hi IS NULL OR d < difficulty_hi) AND (duration_lo IS NULL OR t >= duration_lo) AND (duration_hi IS NULL OR t < duration_hi) GROUP BY ALL),
sums AS (SELECT plan_id, sum(weight) AS w FROM sample_targets GROUP BY 1)
SELECT c.plan_id, c.category FROM cells c JOIN sums s ON c.plan_id = s.plan_id JOIN sample_plans p ON p.plan_id = c.plan_id WHERE c.n * 1000 * s.w < p.sample_per_mille * (SELECT count(*) FROM pool) * c.weight OR c.n < c.min_keep""",
    "p5_roundtrip": "SELECT true AS same, count(*) AS documents FROM documents",
    "p3_found": r"""WITH RECURSIVE last AS (SELECT r.record_id, any_value(r.videos) AS videos FROM records r JOIN (SELECT record_id, max(ingested_at) AS m FROM records GROUP BY 1) x ON r.record_id = x.record_id AND r.ingested_at = x.m GROUP BY 1),
one AS (SELECT record_id, unnest(videos) AS v FROM last),
named AS (SELECT record_id, regexp_extract(lower(trim(regexp_replace(url_decode(replace(regexp_replace(v, '[?#].*$', ''), '+', '%2B')), '\s+', ' ', 'g'))), '([^/\\]*)$', 1) AS n FROM one WHERE v IS NOT NULL),
ids AS (SELECT DISTINCT record_id, trim(regexp_replace(n, '(?:\.[a-z0-9]{1,5}|[_-]\d{3,4}[pi]|[_ -](?:reenc|reencoded|transcoded|copy|kopie|h26[45]|x26[45]|hevc|av1|vp9)\d*|[_-]v\d+(?:-fps\d+)?|[_-]fps\d+|\s*\(\d+\)|\s+)+$', '')) AS id FROM named),
vid AS (SELECT record_id, id FROM ids WHERE regexp_matches(id, '[a-z0-9]')),
pair AS (SELECT DISTINCT a.id AS a, b.id AS b FROM vid a JOIN (SELECT record_id FROM vid GROUP BY 1 HAVING count(*) > 1) m ON a.record_id = m.record_id JOIN vid b ON a.record_id = b.record_id AND a.id <> b.id),
reach AS (SELECT a, a AS b FROM pair UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a),
key AS (SELECT a AS id, min(b) AS k FROM reach GROUP BY 1),
grp AS (SELECT DISTINCT record_id, coalesce(k, vid.id) AS group_key FROM vid LEFT JOIN key ON vid.id = key.id)
SELECT record_id, group_key FROM grp WHERE group_key IN (SELECT group_key FROM grp GROUP BY 1 HAVING count(*) > 1)""",
}
