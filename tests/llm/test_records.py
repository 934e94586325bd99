from pyspark.sql import functions as F

from spanloom.llm import records as R

SPELLINGS = [
    ("video_shards/x/CSD-00000000-01.mp4", "csd-00000000-01"), (" file:///mnt/v/klog%5F90710952.mp4 ", "klog_90710952"), ("D:\\shards\\a\\scaxx9n87", "scaxx9n87"),
    ("store://b/l/lfx_cb96ae2b.h265.mp4?rev=3\n", "lfx_cb96ae2b"), ("datasets/../v/lfx_45701921 (1).mp4", "lfx_45701921"), ("./v//DLP-00000068-02.MP4", "dlp-00000068-02"),
    ("/d/scbzkzejk_v2-fps2.mp4", "scbzkzejk"), ("x_480p.MP4", "x"), ("\tklog_adf4f274\n", "klog_adf4f274"), ("a-reenc.Mp4", "a"), ("a_copy", "a"), ("a_1080P.pt", "a"),
    ("", None), ("  ", None), (None, None), ("folder/", None), ("..", None), ("a%zz.mp4", "a%zz"),
]


def test_video_ids(spark):
    df = spark.createDataFrame([(p,) for p, _ in SPELLINGS], "p string")
    assert [r[0] for r in df.select(R.video_id(F.col("p"))).collect()] == [w for _, w in SPELLINGS]
    many = spark.createDataFrame([(["b.mp4", None, "", "A.mkv", "b.pt"],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in many.select(R.video_ids(F.col("v"))).collect()] == [["a", "b"], [], []]


def test_ids_that_differ_in_a_digit_stay_apart(spark):
    df = spark.createDataFrame([("CSD-00000058-03.mp4",), ("CSD-00000058-02.mp4",), ("CSD-00000059-03.mp4",)], "p string")
    assert df.select(R.video_id(F.col("p"))).distinct().count() == 3


def test_splits_and_types(spark):
    df = spark.createDataFrame([(" Train",), ("TRAINING",), ("dev",), ("Validation ",), ("TEST",), ("other",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(R.split_name(F.col("s"))).collect()] == ["train", "train", "val", "val", "test", "other", None, None]
    df = spark.createDataFrame([("TG",), ("temporal_grounding",), ("Temporal  Grounding",), ("mcq",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(R.problem_type_name(F.col("s"))).collect()] == ["temporal grounding"] * 3 + ["multiple choice", "unknown", "unknown"]


def test_valid_rows(spark):
    rows = [(1, 5, "old", 0), (1, 9, "new", 0), (2, None, "only", 0), (None, 1, "nobody", 0), (1, 9, "new", 0)]
    df = spark.createDataFrame(rows, "record_id long, at long, _row string, _at int").withColumn("ingested_at", F.timestamp_micros("at"))
    got = R.valid_rows(df, value=F.col("_row")).collect()
    assert {tuple(r) for r in got} == {(1, "new"), (2, "only")}
    assert R.valid_rows(df.where("false"), value=F.col("_row")).count() == 0
