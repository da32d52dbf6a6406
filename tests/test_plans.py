"""Physical-plan properties the design relies on at scale."""
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quizmart.operators import changes
from quizmart.operators.scan import running_sum
from quizmart.session import scratch_path
from quizmart.sources import io
from quizmart.sources import standin as sv

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_pushdown_and_pruning(spark):
    plan = _plan(entry.queries()["e2_quiz_results_one_user"](spark, SF))
    assert "EqualTo(o_custkey,31)" in plan and "EqualTo(c_custkey,31)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan  # lineitem: 2 columns
    assert "PartialAggregate" in plan or "HashAggregate(keys=[user_id" in plan or "partial_count" in plan


def test_layout_partition_pruning(spark):
    path = scratch_path(spark, "plan-layout")
    io.write_layout(sv.questions(spark, SF), path, ["status"], ["course_id", "question_id"])
    plan = _plan(spark.read.parquet(path).filter(F.col("status") == "approved"))
    assert "PartitionFilters: [isnotnull(status" in plan and "(status#" in plan and "= approved)" in plan


def test_first_per_key_combines_map_side(spark):
    ga = sv.game_answers(spark, SF)
    firsts, _rest = changes.first_per_key(ga, ["game_id", "user_id", "round_no"], ["answered_at"])
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_scan_carry_is_broadcast(spark):
    e = sv.events(spark, SF)
    plan = _plan(running_sum(e, ["user_id"], ["ts", "event_id"], F.lit(1), "n"))
    assert "BroadcastHashJoin" in plan and "MapInArrow" in plan
    assert "Window" not in plan.split("BroadcastExchange")[0]  # no window over the fact rows


def test_answers_by_game_are_dealt_by_size(spark, tmp_path):
    from quizmart.operators.reports import existing_answer_count
    from quizmart.sources import standin as sv
    d = str(tmp_path)
    n = F.col("id")
    spark.range(0, 2_000_000, 1, 4).select(F.floor(n / 4).alias("l_orderkey"), F.xxhash64("id").alias("l_partkey"), (n % 4).cast("int").alias("l_linenumber"),
                                           F.lit("R").alias("l_returnflag"), F.lit(None).cast("timestamp_ntz").alias("l_shipdate"), F.xxhash64("id", F.lit(1)).alias("l_suppkey"),
                                           n.cast("double").alias("l_extendedprice"), F.lit(1.0).alias("l_quantity")).write.parquet(f"{d}/lineitem.parquet")
    spark.range(500_000).select(n.alias("o_orderkey"), (n % 9).alias("o_custkey")).write.parquet(f"{d}/orders.parquet")
    ga = sv.game_answers(spark, d, by_game=True)
    assert "REPARTITION_BY_NUM" in ga._jdf.queryExecution().executedPlan().toString()
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = existing_answer_count(ga)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert plan.count("Exchange hashpartitioning") == 2  # both sides of the join, none for the aggregate
    assert existing_answer_count(ga).filter("answer_count = 1").count() == 2_000_000
