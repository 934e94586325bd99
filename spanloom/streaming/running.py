"""Running evaluation metrics over results as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a snapshot was written to its end."""
    system, where = _files(spark, path + "/_SUCCESS")
    return system.exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    system, where = _files(spark, path)
    system.delete(where, True)


def _snapshots(spark: SparkSession, place: str) -> list[int]:
    """The numbers of the snapshots of a place."""
    system, where = _files(spark, place)
    names = [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []
    return sorted(int(n.split("-")[1]) for n in names if n.startswith("snapshot-") and _exists(spark, f"{place}/{n}"))


def running_summary(spark: SparkSession, folder: str, schema, place: str, group: str, key: str, value: str, time: str, delay: str = "60 days", files_per_batch: int = 1) -> DataFrame:
    """``group``, ``n``, ``mean``: number and mean of ``value`` per group of the results in a folder of Parquet files, read as a stream.

    Files are taken ``files_per_batch`` at a time, and every micro-batch rewrites the snapshot of the totals. ``place`` is the
    caller's folder: called again with the same one, the stream goes on from its checkpoint and reads only new files.
    A key that comes again within ``delay`` of its ``time`` counts once; what comes later than that is left out, so
    the state holds the keys of that time alone. Returns the last snapshot.
    """
    results = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    once = results.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])

    def add(batch: DataFrame, number: int) -> None:
        """The totals of this batch on top of the snapshot before it; a batch that is run again starts from the same one."""
        own = batch.groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.count(value).alias("known"))
        before = [p for p in _snapshots(spark, place) if p < number]
        if before:
            own = own.unionByName(spark.read.parquet(f"{place}/snapshot-{before[-1]}")).groupBy(group).agg(*[F.sum(c).alias(c) for c in ("n", "total", "known")])
        own.write.mode("overwrite").parquet(f"{place}/snapshot-{number}")
        for p in before[:-1]:
            _delete(spark, f"{place}/snapshot-{p}")

    query = once.writeStream.foreachBatch(add).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = _snapshots(spark, place)
    if not kept:
        return spark.createDataFrame([], f"{group} string, n long, mean double")
    snapshot = spark.read.parquet(f"{place}/snapshot-{kept[-1]}")
    return snapshot.select(group, "n", (F.col("total") / F.col("known")).alias("mean"))


def late_events(spark: SparkSession, folder: str, schema, watermark: str = "2 days") -> DataFrame:
    """Counts and means of events per day and type; events later than the watermark are dropped by the stream."""
    place = scratch(spark, "late")
    events = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    days = events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    out = days.select(F.col("w.start").cast("date").cast("string").alias("day"), "event_type", "n", "mean")

    def snapshot(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{place}/days")

    out.writeStream.outputMode("append").foreachBatch(snapshot).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/days")
