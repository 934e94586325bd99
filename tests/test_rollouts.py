from pyspark.sql import functions as F

from spanloom.plans import registry
from spanloom.storage import table


def test_every_output_joins_its_group(spark, data):
    got = registry.QUERIES["j3_rollout_groups"](spark, data)
    outs, runs = table(spark, data, "reward_inputs"), table(spark, data, "runs")
    key = ["uid", "slot", "rollout_id"]
    assert got.where("rollout_id IS NOT NULL").select(key).exceptAll(outs.select(key)).count() == 0
    assert outs.select(key).exceptAll(got.select(key)).count() == 0
    most = runs.agg(F.max("rollout_n")).first()[0]
    assert {r.slot for r in got.select("slot").distinct().collect()} == set(range(most))
    assert got.where("problem_id IS NULL").count() == 0
