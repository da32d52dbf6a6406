"""Stored tables: erasure touches only the files it must; the audit stream reads only its buckets."""
import datetime as dt
import os

import pytest

from conftest import rows
from quizmart.operators import changes, reports
from quizmart.session import scratch_path
from quizmart.sources import stored
from quizmart.streaming import carried, streams

T0 = dt.datetime(2024, 1, 1)


def local(path):
    return path.removeprefix("file:")


def names(root):
    return {os.path.relpath(os.path.join(d, f), local(root)) for d, _, fs in os.walk(f"{local(root)}/data") for f in fs if f.endswith(".parquet")}


def test_erasure_rewrites_only_files_that_hold_the_user(spark):
    root = scratch_path(spark, "erase")
    t = spark.range(2000).selectExpr("id", "id % 50 AS user_id", "CASE WHEN id % 7 = 0 THEN id % 50 END AS made_by")
    before = stored.create(t, root, ["user_id"], 32)
    ids = spark.createDataFrame([(3,), (999,)], "user_id long")
    replaced, written = stored.erase_stored(spark, root, ids, "user_id", ["made_by"])
    after = stored.manifest(spark, root)
    assert rows(stored.read(spark, root)) == rows(t.filter("user_id <> 3").selectExpr("id", "user_id", "CASE WHEN made_by <> 3 THEN made_by END AS made_by"))
    assert 0 < len(replaced) < len(before.files) / 2 and set(after.files) == set(before.files) - set(replaced) | set(written)
    assert set(before.files) - set(replaced) <= set(after.files)  # untouched files keep their names
    assert rows(stored.read(spark, root, version=0)) == rows(t)  # readers of the old version still see it
    assert set(stored.vacuum(spark, root, 1)) == set(replaced) and names(root) == set(after.files)
    assert stored.erase_stored(spark, root, ids) == ([], []) and stored.latest_version(spark, root) == 1


def test_a_failed_change_leaves_the_version(spark, monkeypatch):
    root = scratch_path(spark, "atomic")
    t = spark.range(100).selectExpr("id", "id % 5 AS user_id")
    stored.create(t, root)
    monkeypatch.setattr(stored, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        stored.erase_stored(spark, root, spark.createDataFrame([(1,)], "user_id long"))
    monkeypatch.undo()
    assert rows(stored.read(spark, root)) == rows(t)
    stored.erase_stored(spark, root, spark.createDataFrame([(1,)], "user_id long"))  # the repeated run replaces its files
    assert rows(stored.read(spark, root)) == rows(t.filter("user_id <> 1"))


def test_empty_and_unbucketed_tables(spark):
    root = scratch_path(spark, "none")
    stored.create(spark.range(0).selectExpr("id AS user_id"), root, ["user_id"], 4)
    assert stored.read(spark, root).collect() == [] and stored.read(spark, root, buckets=[1]).columns == ["user_id"]
    assert stored.erase_stored(spark, root, spark.range(1).selectExpr("id AS user_id")) == ([], [])


def test_audit_stream_reads_only_its_buckets(spark, monkeypatch):
    root, audit = scratch_path(spark, "buckets"), scratch_path(spark, "log")
    first = spark.range(0, 1000).selectExpr("id AS k", "id * 10 AS v")
    stored.create(first, root, ["k"], 64)
    src = scratch_path(spark, "versions")
    batches = [[(5, 1, "UPSERT"), (2000, 2, "UPSERT")], [(5, 2, "UPSERT"), (6, 0, "DELETE"), (7777, 0, "DELETE")], [(5, 3, "UPSERT"), (6, 9, "UPSERT"), (2000, 0, "DELETE")], [(5, 4, "UPSERT")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "k long, v long, op string").coalesce(1).write.parquet(f"{src}/{i}")
        for f in os.listdir(f"{local(src)}/{i}"):
            os.utime(f"{local(src)}/{i}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    read = []
    whole = stored.read_files
    monkeypatch.setattr(stored, "read_files", lambda s, r, m, files: (read.append((len(files), len(m.files))), whole(s, r, m, files))[1])
    stream = spark.readStream.schema("k long, v long, op string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    streams.run_available_now(carried.stream_audit_stored(stream, root, audit, "t", T0, op_col="op"), "t-stored", spark)
    monkeypatch.undo()
    assert rows(spark.read.parquet(audit), "batch_id", "k", "operation") == rows(spark.createDataFrame(
        [(0, 5, "UPDATE"), (0, 2000, "INSERT"), (1, 5, "UPDATE"), (1, 6, "DELETE"), (2, 5, "UPDATE"), (2, 6, "INSERT"), (2, 2000, "DELETE"), (3, 5, "UPDATE")], "batch_id int, k long, operation string"))
    want = first.filter("k <> 5 AND k <> 6").unionAll(spark.createDataFrame([(5, 4), (6, 9)], "k long, v long"))
    assert rows(stored.read(spark, root)) == rows(want)
    assert all(n <= 12 < total for n, total in read), read  # of about 250 files, the four of a touched bucket
    old = [r.old_values for r in spark.read.parquet(audit).filter("k = 5").orderBy("batch_id").collect()]
    assert old == ['{"k":5,"v":50}', '{"k":5,"v":1}', '{"k":5,"v":2}', '{"k":5,"v":3}']


def test_incremental_totals_equal_the_recompute(spark):
    answers = spark.createDataFrame([(i, 0, i % 2 == 0) for i in range(10)], "answer_id int, question_id int, right_wrong boolean")
    games = spark.createDataFrame([(g,) for g in range(4)], "game_id int")
    schema = "game_id int, user_id int, answer_id int, round_no int, right_wrong boolean, answered_at timestamp_ntz"
    data = [((i * 3) % 5, i % 6, (i * 7) % 11, i % 4 if i % 13 else None, None, T0 + dt.timedelta(minutes=(i * 37) % 50)) for i in range(240)]
    history, total = spark.createDataFrame([], schema), spark.createDataFrame([], "user_id int, score long")
    for k in range(3):
        incoming = spark.createDataFrame(data[k::3], schema)
        accepted, _, delta, total = changes.ingest_delta(history, incoming, answers, games, total)
        whole, _, want = changes.ingest_answers(history, incoming, answers, games)
        assert rows(accepted) == rows(whole)
        assert rows(total, "user_id", "score") == rows(want, "user_id", "score")
        history = history.unionByName(accepted).checkpoint()
        total = total.checkpoint()
    assert rows(total, "user_id", "score") == rows(reports.user_scores(history, games), "user_id", "score")
    groups = spark.createDataFrame([(1, 0, 7), (2, 99, 8)], "game_id int, user_id int, score int")
    assert rows(changes.refresh_group_scores(groups, total), "user_id", "score")[1] == (99, 8)


def test_history_is_not_read_for_totals(spark):
    keys = spark.createDataFrame([], "game_id int, user_id int, round_no int")  # keys alone are enough
    incoming = spark.createDataFrame([(1, 1, 1, 1, None, T0)], "game_id int, user_id int, answer_id int, round_no int, right_wrong boolean, answered_at timestamp_ntz")
    answers = spark.createDataFrame([(1, 0, True)], "answer_id int, question_id int, right_wrong boolean")
    _, _, delta, total = changes.ingest_delta(keys, incoming, answers, spark.createDataFrame([(1,)], "game_id int"), spark.createDataFrame([(1, 90)], "user_id int, score long"))
    assert rows(delta) == [(1, 10)] and rows(total) == [(1, 100)]
