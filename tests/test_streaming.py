import datetime

from spanloom.streaming import running


def test_a_restart_goes_on(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    schema = "id long, run string, iou double, at timestamp"
    folder, place = str(tmp_path / "in"), str(tmp_path / "place")
    args = (folder, spark.createDataFrame([], schema).schema, place, "run", "id", "iou", "at", "5 days")

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def totals():
        return {r.run: (r.n, r.mean) for r in running.running_summary(spark, *args).collect()}

    add((1, "a", 0.5, day(0)), (2, "b", None, day(0)))
    assert totals() == {"a": (1, 0.5), "b": (1, None)}
    assert totals() == {"a": (1, 0.5), "b": (1, None)}  # nothing new
    add((1, "a", 0.5, day(0)), (3, "a", 1.0, day(2)), (4, "c", 0.25, day(90)))
    assert totals() == {"a": (2, 0.75), "b": (1, None), "c": (1, 0.25)}
    add((5, "c", 0.75, day(91)))
    assert totals() == {"a": (2, 0.75), "b": (1, None), "c": (2, 0.5)}
