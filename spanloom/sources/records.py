"""JSON in and out: lines or one array, strict or tolerant, annotations keyed by video, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ANNOTATIONS = "map<string, struct<duration: double, queries: array<string>, sentences: array<string>, spans: array<array<double>>, timestamps: array<array<double>>>>"


def lines(spark: SparkSession, path: str, schema: str | StructType, tolerant: bool = False) -> DataFrame:
    """One JSON object per line. Blank lines are skipped; a malformed line raises, or is skipped if ``tolerant``."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    if tolerant:
        kept = spark.read.schema(_with_corrupt(spark, schema)).option("columnNameOfCorruptRecord", "_bad").json(path)
        return kept.where(F.col("_bad").isNull()).drop("_bad")
    parsed = rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x"))
    return parsed.select("x.*")


def _with_corrupt(spark: SparkSession, schema: str | StructType) -> StructType:
    parsed = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    return StructType([*parsed.fields]).add("_bad", "string")


def lines_or_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON array, or objects on lines, told by the first character that is no blank."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if head and head[0][0].lstrip().startswith("["):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return lines(spark, path, schema)


def annotations(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """``video_path``, ``duration``, ``query``, ``span``: a row per query of each video of one JSON object.

    ``queries`` or ``sentences`` meet ``spans`` or ``timestamps`` in order, up to the shorter of the two.
    """
    from ..functions.parsing import levelled_query

    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", ANNOTATIONS)).alias("video", "a"))
    q, s = F.coalesce("a.queries", "a.sentences"), F.coalesce("a.spans", "a.timestamps")
    n = F.least(F.size(q), F.size(s))
    pairs = F.when(n > 0, F.arrays_zip(F.slice(q, 1, n).alias("query"), F.slice(s, 1, n).alias("span")))
    rows = whole.select(F.concat(F.lit(root), "video", F.lit(".mp4")).alias("video_path"), F.coalesce("a.duration", F.lit(0.0)).alias("duration"), F.explode(pairs).alias("p"))
    return rows.select("video_path", "duration", levelled_query(F.col("p.query")).alias("query"), F.array("p.span").alias("span"))


def by_extension(spark: SparkSession, path: str) -> DataFrame:
    """A table by the kind its ending names; ``path@part`` names a part folder of it."""
    path, _, part = path.partition("@")
    place = f"{path}/{part}" if part else path
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    return spark.read.format({"jsonl": "json"}.get(kind, kind if kind in ("json", "csv", "parquet", "orc", "text") else "parquet")).load(place)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, NULLs left out."""
    df.write.mode("overwrite").json(path)


def write_split(df: DataFrame, good: str, path: str) -> None:
    """Rows where ``good`` holds, and the others under ``.failed``."""
    write_lines(df.where(good), path)
    write_lines(df.where(f"NOT coalesce({good}, false)"), path + ".failed")


def ratio_or(ratio: Column, default: list[int]) -> Column:
    """An aspect ratio of two numbers, or the default where there is none."""
    return F.when(F.size(ratio) == 2, ratio).otherwise(F.array(*[F.lit(x) for x in default]))


# The benches and how many events each has.
BENCHES = [("charades", 3363), ("activitynet", 4500), ("qvhighlights", 1541)]


def benches(spark: SparkSession, given: list[tuple[str, int]] | None = None) -> DataFrame:
    """``name``, ``listed``: the registered benches, with others that are given; a name given again takes the new number."""
    rows = {**dict(BENCHES), **dict(given or [])}
    return spark.createDataFrame(list(rows.items()), "name string, listed int")


def bench_counts(registry: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """Per bench how many events are found and whether that is all. Events of no registered bench count nowhere."""
    found = events.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("_n"))
    return registry.join(found, "name", "left").select("name", "listed", F.coalesce("_n", F.lit(0)).alias("found"), (F.coalesce("_n", F.lit(0)) == F.col("listed")).alias("complete"))
