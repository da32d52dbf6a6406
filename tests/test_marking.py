"""First per key by one range layout; task sizes by the size of the input."""
import random

from pyspark.sql import functions as F

from conftest import rows
from quizmart.operators import changes


def test_first_of_a_hot_key_over_many_partitions(spark, monkeypatch):
    from quizmart.operators import scan
    rnd = random.Random(4)
    data = [(None if i % 50 == 7 else 0 if rnd.random() < 0.5 else rnd.randrange(30), None if i % 31 == 0 else rnd.randrange(40), i if i % 3 else 5, rnd.random() < 0.7)
            for i in range(1500)]
    data += data[:200]  # exact copies
    df = spark.createDataFrame(data, "k long, t long, v long, fit boolean")
    monkeypatch.setattr(scan, "_num_partitions", lambda df, n: 16)
    rank = lambda r: tuple((x is not None, x) for x in (r[1], r[2], r[3]))
    for safe in (True, False):
        fit = [r for r in data if r[3] and (safe or r[0] is not None)]
        want = sorted(min((r for r in fit if r[0] == k), key=rank) for k in {r[0] for r in fit if r[0] is not None})
        marked = changes.mark_first(df, ["k"], ["t"], eligible=F.col("fit"), null_safe=safe)
        got = [tuple(r)[:4] for r in marked.collect() if r["__first"]]
        assert sorted(r for r in got if r[0] is not None) == want
        none = [r for r in got if r[0] is None]
        assert none == ([min((r for r in fit if r[0] is None), key=rank)] if safe else [])
        assert rows(marked.drop("__first")) == rows(df)
    spread = marked.filter("k = 0").groupBy(F.spark_partition_id()).count().count()
    assert spread > 3


def test_marking_shuffles_its_rows_once(spark):
    df = spark.range(1000).select((F.col("id") % 300).alias("k"), F.col("id").alias("t"))
    plan = changes.mark_first(df, ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan and "partial_min" in plan
    by_rows = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "__hi" not in x and "__lo" not in x]
    assert not by_rows
