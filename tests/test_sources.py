import json

import pytest

from spanloom.sources import records as J
from spanloom.streaming import running


def test_lines(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"a": 1}\n\n  \n{"a": 2, "b": "x"}\n')
    assert [tuple(r) for r in J.lines(spark, str(f), "a int, b string").collect()] == [(1, None), (2, "x")]
    f.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        J.lines(spark, str(f), "a int").collect()
    assert [r.a for r in J.lines(spark, str(f), "a int", tolerant=True).collect()] == [1]


def test_array_or_lines(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    assert J.lines_or_array(spark, str(f), "a int").count() == 2
    f.write_text('{"a": 1}\n{"a": 2}\n{"a": 3}')
    assert J.lines_or_array(spark, str(f), "a int").count() == 3


def test_annotations_cut_to_the_shorter(spark, tmp_path):
    f = tmp_path / "bench.json"
    f.write_text(json.dumps({"v1": {"duration": 9.0, "queries": [" a  b. ", "c"], "spans": [[1.0, 2.0]]}, "v2": {"sentences": ["d"], "timestamps": [[0.0, 3.0], [4.0, 5.0]]}}))
    got = {(r.video_path, r.duration, r.query, tuple(map(tuple, r.span))) for r in J.annotations(spark, str(f), "/v/").collect()}
    assert got == {("/v/v1.mp4", 9.0, "a b", ((1.0, 2.0),)), ("/v/v2.mp4", 0.0, "d", ((0.0, 3.0),))}


def test_late_events(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-09 10:00:00", "a", 2.0)], "ts string, event_type string, value double").selectExpr("CAST(ts AS timestamp) ts", "event_type", "value")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = running.late_events(spark, str(tmp_path / "in"), rows.schema).collect()
    assert [tuple(r) for r in got] == [("2024-01-01", "a", 1, 1.0)]
