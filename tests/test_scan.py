"""The skew-proof scan equals the window functions, with a hot key split over many partitions."""
import random

import pandas as pd
from pyspark.sql import functions as F

from conftest import rows
from quizmart.operators.scan import previous_in_key, running_sum, sequence_number


def _data(n=3000, seed=7):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        # key 0 holds a third of all rows; some keys are NULL
        k = 0 if i % 3 == 0 else (None if i % 97 == 0 else rnd.randint(1, 40))
        out.append((i, k, rnd.randint(0, 10_000), rnd.randint(-5, 5)))
    return out


def _expected(data, keyed=True):
    pdf = pd.DataFrame(data, columns=["id", "k", "t", "v"])
    pdf["kk"] = pdf["k"].fillna(-1) if keyed else 0
    pdf = pdf.sort_values(["kk", "t", "id"])
    pdf["rs"] = pdf.groupby("kk")["v"].cumsum()
    pdf["pos"] = pdf.groupby("kk").cumcount() + 1
    return pdf


def test_running_sum_hot_key(spark):
    data = _data()
    df = spark.createDataFrame(data, "id long, k long, t long, v long")
    got = running_sum(df, ["k"], ["t", "id"], F.col("v"), "rs", num_partitions=16)
    exp = _expected(data)
    assert dict(rows(got, "id", "rs")) == dict(zip(exp["id"], exp["rs"]))


def test_sequence_number_global(spark):
    data = _data(1500, seed=3)
    df = spark.createDataFrame(data, "id long, k long, t long, v long")
    got = dict(rows(sequence_number(df, [], ["t", "id"], "pos", num_partitions=12), "id", "pos"))
    exp = _expected(data, keyed=False)
    assert got == dict(zip(exp["id"], exp["pos"]))


def test_previous_in_key(spark):
    data = _data(800, seed=5)
    df = spark.createDataFrame(data, "id long, k long, t long, v long")
    got = dict(rows(previous_in_key(df, ["k"], ["t", "id"], ["id"], prefix="p_"), "id", "p_id"))
    exp = _expected(data)
    exp["prev"] = exp.groupby("kk")["id"].shift(1)
    want = {i: (None if pd.isna(p) else int(p)) for i, p in zip(exp["id"], exp["prev"])}
    assert got == want


def test_scan_passes_far_timestamps_through(spark):
    import datetime as dt
    far = dt.datetime(9999, 12, 31)
    df = spark.createDataFrame([(k, i, far) for k in (1, None) for i in range(20)], "k long, id long, t timestamp_ntz")
    got = rows(running_sum(df, ["k"], ["id"], F.col("id"), "s", num_partitions=7), "k", "id", "s")
    got = sorted(got, key=lambda x: x[1])
    assert [x[2] for x in got if x[0] == 1] == [sum(range(i + 1)) for i in range(20)]
    assert [x[2] for x in got if x[0] is None] == [sum(range(i + 1)) for i in range(20)]
