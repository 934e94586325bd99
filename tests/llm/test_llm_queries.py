import pytest

from oracle import connect, differences
from spanloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_sql(spark, data, name):
    assert differences(spark, connect(data), Q.QUERIES[name], Q.ORACLE_SQL[name], data) == ([], [], 0)


def test_columns(spark, data):
    want = {
        "p1_found": {"plan_id": "int", "category": "string"}, "p2_found": {"record_id_a": "bigint", "record_id_b": "bigint"}, "p3_found": {"record_id": "bigint", "group_key": "string"},
        "p4_found": {"rollout_id": "bigint", "field": "string", "defect": "string"}, "p5_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p6_found": {"plan_id": "int", "doc_id": "bigint"}, "p7_found": {"doc_id": "bigint", "subject": "string"},
    }
    for name, columns in want.items():
        assert dict(Q.QUERIES[name](spark, data).dtypes) == columns
