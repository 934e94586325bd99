import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanloom.functions import sequences as S
from spanloom.operators import batch as B
from spanloom.operators import configs as C
from spanloom.operators import hooks as H
from spanloom.operators import media as M
from spanloom.operators import prompts as Q
from spanloom.operators.sampling import gaussian, quotas, smallest_per_bucket

META = M.METADATA
SAMPLE = f"id long, video struct<source_type: string, paths: array<string>, frames: array<int>, metadatas: array<{META}>>, tensors array<int>, video_metadatas array<{META}>, preprocessed_video_path string, videos array<string>"


def resolve(spark, **given):
    row = {"id": 1, "video": None, "tensors": None, "video_metadatas": None, "preprocessed_video_path": None, "videos": None, **given}
    files = spark.createDataFrame([("a", 4, None)], f"path string, frames int, metadata {META}")
    return M.resolved(spark.createDataFrame([tuple(row.values())], SAMPLE), files, "id").collect()


def test_resolved_videos_raise(spark):
    for bad in ({"video": ("inline", None, [1], None)}, {"video": ("other", ["a"], None, None)}, {"videos": ["b"]}, {"preprocessed_video_path": "b"}):
        with pytest.raises(PySparkException):
            resolve(spark, **bad)
    assert resolve(spark) == [] and resolve(spark, videos=[]) == []
    (r,) = resolve(spark, preprocessed_video_path="a", videos=["b"])
    assert (r.origin, r.frames, r.metadata.fps, r.metadata.indices) == ("preprocessed", 4, 2.0, [0, 1, 2, 3])


def test_contents_of_one_kind_only(spark):
    one = spark.range(1)
    x = F.array(F.lit("x"))
    with pytest.raises(PySparkException):
        one.select(M.contents(F.lit("a <image> <video>"), x, x)).collect()
    none = F.array().cast("array<string>")
    got = one.select(M.contents(F.lit("<image>a<image>"), x, none).alias("c"), M.contents(F.lit("<image>"), none, none).alias("d")).first()
    assert [(p.type, p.text) for p in got.c] == [("image", None), ("text", "a"), ("image", None)] and got.d[0].text == "<image>"


def test_functions_by_spec(spark, tmp_path):
    file = tmp_path / "own.py"
    file.write_text("def main(x):\n    return x + 1\n\ndef other(x):\n    return x + 2\n")
    assert H.load_function(str(file))(1) == 2 and H.load_function(f"{file}:other")(1) == 3
    assert H.load_function("math:sqrt")(9) == 3
    with pytest.raises(AttributeError):
        H.load_function(f"{file}:none")


def test_scores_and_sinks_raise(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "id long, iou double")
    with pytest.raises(ValueError):
        H.scored_by(df, len, "id", ["iou"], "odd")
    with pytest.raises(PySparkException):
        H.scored_by(df, lambda rows: [], "id", ["iou"]).collect()
    assert H.scored_by(df.where("false"), lambda rows: [], "id", ["iou"]).collect() == []
    with pytest.raises(ValueError):
        H.tracked(df, ["lines", "nowhere"], str(tmp_path), 1)
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError):
        H.sink("lines")(print)
    H.tracked(spark.createDataFrame([("a", None)], "metric string, value double"), ["text"], str(tmp_path), 3)
    assert spark.read.text(f"{tmp_path}/text").first()[0] == "step 3: metric=a, value=n/a"


def test_dispatch_raises(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "pos long")
    with pytest.raises(ValueError):
        H.dispatched(df, "nothing", 2, lambda p: p, "pos long")
    with pytest.raises(ValueError):
        H.dispatched(df, "stretches", 2, lambda p: p, "pos long")


def test_timer_counts_failures_too():
    held = {}
    with pytest.raises(ZeroDivisionError), H.timed("a", held):
        1 / 0
    assert held["a"] >= 0


def test_configurations(spark):
    sizes = spark.createDataFrame([(1e9,), (9e9,)], "n double")
    assert sizes.select(C.checked_size(F.col("n"))).count() == 2
    for bad in (0.0, 9.1e9, None):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "n double").select(C.checked_size(F.col("n"))).collect()
    with pytest.raises(ValueError):
        Q.filled("{nothing}", sizes)


def test_log_probs_raise(spark):
    schema = "tokens array<long>, tables array<map<long,double>>"
    whole = [([1] * 200, [{1: -0.5}] * 200)]
    assert len(S.checked_log_probs(spark.createDataFrame(whole, schema), "tokens", "tables", 201).first().log_probs) == 201
    one = [([1] * 199 + [2], [{1: -0.5}] * 200)]
    assert S.checked_log_probs(spark.createDataFrame(one, schema), "tokens", "tables", 200).first().log_probs[-1] == -0.5
    with pytest.raises(ValueError, match="chosen tokens"):
        S.checked_log_probs(spark.createDataFrame([([2] * 3, [{1: -0.5}] * 3)], schema), "tokens", "tables", 3)
    with pytest.raises(ValueError, match="sequences"):
        S.checked_log_probs(spark.createDataFrame(whole + [([1], [])], schema), "tokens", "tables", 3)


def test_maps_and_places(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(B.united_maps(F.create_map(F.lit("a"), F.lit(1).cast("long")), F.create_map(F.lit("a"), F.lit(2).cast("long")))).collect()
    e = spark.range(5).withColumnRenamed("id", "pos")
    assert [r.pos for r in B.restarted(e, 5, 12).orderBy("draw").collect()] == [0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 0, 1]
    assert B.restarted(e.where("false"), 0, 3).count() == 0


def test_quotas():
    assert quotas([1, 1, 1], 4) == [2, 1, 1] and quotas([0, 3, 1], 0) == [0, 0, 0] and quotas([0.1] * 10, 10) == [1] * 10
    assert quotas([5, 0, 0], 7) == [7, 0, 0] and sum(quotas([0.3, 0.3, 0.3], 10**12 + 1)) == 10**12 + 1
    for bad in (([], 3), ([0, 0], 3), ([1, -1, 1], 3), ([1], -1)):
        with pytest.raises(ValueError):
            quotas(*bad)


def test_samples_of_any_share(spark):
    """Neither a share of the whole nor a threshold that lets too little through changes what is drawn."""
    rows = spark.range(9000).select("id", (F.col("id") % 10).alias("difficulty10"), ((F.col("id") % 97) / 97).alias("difficulty"), F.lit(0).alias("b"))
    for n in (10, 3000, 9000, 20000):
        assert gaussian(rows, n, 0.5, 0.2, 3, "id").count() == min(n, 9000)
    got = smallest_per_bucket(rows, "b", F.md5(F.col("id").cast("string")), {0: 2500}).where("_rank <= 2500").select("id")
    want = rows.orderBy(F.md5(F.col("id").cast("string"))).limit(2500).select("id")
    assert got.count() == 2500 and got.exceptAll(want).count() == 0


def test_joint_targets(spark, tmp_path):
    from spanloom.operators.dispatch import joint_targets
    assert joint_targets(spark, None) is None and joint_targets(spark, "") is None
    assert [tuple(r) for r in joint_targets(spark, {"0|1": 3, "1,0": 1, "2|2": 0}).orderBy("row").collect()] == [(0, 1, 0.75), (1, 0, 0.25)]
    for bad in ({"0|0": 0}, {"0|0": -1, "1|1": 3}, {"5|0": 1}, [[1] * 6]):
        with pytest.raises(ValueError):
            joint_targets(spark, bad)


def test_a_listing_as_long_as_the_layout_is_not_broadcast(spark):
    """The estimate of a listing that is made by exploding is that of the rows before."""
    layout = C.save_layout(spark.range(3000).withColumnRenamed("id", "step"), 4)
    listing = layout.where((F.col("step") % 3 == 0) | ((F.col("step") % 3 == 1) & ~F.col("path").contains("/optim_"))).select("path")
    got = C.restorable(layout, listing.union(listing))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.step, r.wanted, r.missing) for r in got.collect()} == {(k, 14, (0, 4, 14)[k % 3]) for k in range(3000)}
