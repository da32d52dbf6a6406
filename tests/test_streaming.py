"""Stream twins equal their batch twins, also over several micro-batches."""
import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from quizmart.operators import changes, sessions
from quizmart.session import scratch_path
from quizmart.streaming import carried, keyed, streams

T0 = dt.datetime(2024, 1, 1)


def _write_batches(spark, frames, name):
    """Write frames as numbered files of one folder (file k = micro-batch k with maxFilesPerTrigger=1)."""
    root = scratch_path(spark, "src")
    import os
    import time
    for i, f in enumerate(frames):
        tmp = scratch_path(spark, "part")
        f.coalesce(1).write.parquet(tmp)
        part = [p for p in os.listdir(tmp) if p.endswith(".parquet")][0]
        os.makedirs(root, exist_ok=True)
        os.replace(os.path.join(tmp, part), os.path.join(root, f"{name}-{i:03d}.parquet"))
        t = time.time() + i
        os.utime(os.path.join(root, f"{name}-{i:03d}.parquet"), (t, t))
    return root


def test_lobby_and_presence_streams_match_batch(spark):
    ev = [(i, T0 + dt.timedelta(minutes=i), (i * 7) % 5, ["requestJoin", "requestJoin", "disconnect"][i % 3], "L")
          for i in range(60)]
    schema = "event_id long, ts timestamp_ntz, user_id long, kind string, lobby string"
    df = spark.createDataFrame(ev, schema)
    src = _write_batches(spark, [df.filter(f"event_id >= {a} and event_id < {a + 20}") for a in (0, 20, 40)], "ev")
    stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
              .withColumn("ts", F.col("ts").cast("timestamp")))
    out = scratch_path(spark, "pairs")
    streams.run_available_now(streams.stream_lobby(stream).writeStream.format("parquet"), "t-k3", spark, out)
    got = rows(spark.read.parquet(out), "group_no", "player1", "player2", "event_id")
    want = rows(sessions.lobby_pairs(df), "group_no", "player1", "player2", "event_id")
    assert got == want and len(got) > 5
    out4 = scratch_path(spark, "presence")
    streams.run_available_now(streams.stream_presence(stream, connect="requestJoin").writeStream.format("parquet"), "t-k4", spark, out4)
    deltas = dict(rows(spark.read.parquet(out4), "event_id", "delta"))
    tl = dict(rows(sessions.concurrency_timeline(df, connect="requestJoin"), "event_id", "connected"))
    running, ok = 0, True
    for eid in sorted(tl):
        running += deltas.get(eid, 0)
        ok &= running == tl[eid]
    assert ok


def test_answer_stream_first_wins_across_batches(spark):
    schema = "game_id long, user_id long, answer_id long, round_no int, right_wrong boolean, answered_at timestamp_ntz"
    b1 = [(1, 1, 10, 1, False, T0), (1, 1, 11, 2, False, T0), (1, 1, 99, 3, True, T0)]
    b2 = [(1, 1, 12, 1, True, T0 + dt.timedelta(1)), (1, 1, 13, 3, True, T0 + dt.timedelta(1))]
    d1, d2 = spark.createDataFrame(b1, schema), spark.createDataFrame(b2, schema)
    answers = spark.createDataFrame([(10, True), (11, False), (12, True), (13, False)], "answer_id long, right_wrong boolean")
    src = _write_batches(spark, [d1, d2], "ga")
    stream = spark.readStream.schema(d1.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink, q = scratch_path(spark, "k1"), scratch_path(spark, "k1q")
    streams.run_available_now(streams.stream_answers(stream, answers, sink, q), "t-k1", spark)
    got = rows(spark.read.parquet(sink), "answer_id", "right_wrong")
    # batch 1: 99 unknown; batch 2: round 1 already stored, round 3 free (99 was never stored)
    assert got == [(10, True), (11, False), (13, False)]
    assert rows(spark.read.parquet(q), "answer_id", "reason") == [(12, "duplicate_existing"), (99, "unknown_answer")]
    batch_acc, _ = changes.duplicate_round_answers(changes.score_answers(d1.unionByName(d2), answers)[0])
    assert rows(batch_acc, "answer_id") == [(10,), (11,), (13,)]


def test_score_updates_across_batches(spark):
    from quizmart.operators import reports
    schema = "game_id long, user_id long, right_wrong boolean"
    b1 = spark.createDataFrame([(1, 1, True), (1, 2, False), (9, 1, True)], schema)
    b2 = spark.createDataFrame([(1, 1, True), (1, 3, True)], schema)
    games = spark.createDataFrame([(1,)], "game_id long")
    src = _write_batches(spark, [b1, b2], "sc")
    stream = spark.readStream.schema(b1.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = scratch_path(spark, "k2")
    streams.run_available_now(streams.write_updates(streams.stream_scores(stream, games), out), "t-k2", spark)
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 2
    got = rows(streams.latest_values(out, spark, ["user_id"]), "user_id", "score")
    assert got == rows(reports.user_scores(b1.unionByName(b2), games), "user_id", "score") == [(1, 20), (2, 0), (3, 10)]


def test_audit_stream_versions_across_batches(spark):
    schema = "id long, name string, v long"
    target, audit = scratch_path(spark, "k7t"), scratch_path(spark, "k7a")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).write.parquet(f"{target}/batch_id=-1")
    b1 = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (3, "c", 1)], schema)  # update 1, same 2, insert 3
    b2 = spark.createDataFrame([(1, "a", 3)], schema)                             # update 1 again
    src = _write_batches(spark, [b1, b2], "up")
    stream = spark.readStream.schema(b1.schema).option("maxFilesPerTrigger", 1).parquet(src)
    streams.run_available_now(streams.stream_audit(stream, target, audit, ["id"], "t", "2024-02-01 00:00:00"),
                              "t-k7", spark)
    log = spark.read.parquet(audit).select(
        "batch_id", "id", "operation", F.get_json_object("old_values", "$.v").alias("old_v"),
        F.get_json_object("new_values", "$.v").alias("new_v"))
    assert rows(log) == [(0, 1, "UPDATE", "1", "2"), (0, 2, "UPDATE", "1", "1"), (0, 3, "INSERT", None, "1"),
                         (1, 1, "UPDATE", "2", "3")]
    assert rows(streams.compact_versions(spark, target, ["id"], 1)) == [(1, "a", 3), (2, "b", 1), (3, "c", 1)]


def test_audit_stream_logs_deletions(spark):
    schema = "id long, v long, op string"
    target, audit = scratch_path(spark, "k7t"), scratch_path(spark, "k7a")
    spark.createDataFrame([(1, 1), (2, 1)], "id long, v long").write.parquet(f"{target}/batch_id=-1")
    frames = [spark.createDataFrame(b, schema) for b in ([(1, 1, "DELETE"), (9, 1, "DELETE")], [(1, 5, "UPSERT")], [(1, 0, "DELETE")])]
    src = _write_batches(spark, frames, "del")
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(src)
    streams.run_available_now(streams.stream_audit(stream, target, audit, ["id"], "t", "2024-02-01 00:00:00", op_col="op"),
                              "t-k7d", spark)
    assert rows(spark.read.parquet(audit), "batch_id", "id", "operation") == [(0, 1, "DELETE"), (1, 1, "INSERT"), (2, 1, "DELETE")]
    assert rows(streams.compact_versions(spark, target, ["id"], 2)) == [(2, 1)]


def test_presence_notices_need_a_join(spark):
    ev = [(1, 1, "connect"), (2, 2, "connect"), (3, 1, "join-chat"), (4, 1, "disconnect"), (5, 2, "disconnect"), (6, 1, "disconnect"),
          (7, 1, "requestJoin")]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i), u, k) for i, u, k in ev],
                               "event_id long, ts timestamp_ntz, user_id long, kind string")
    src = _write_batches(spark, [df.filter("event_id <= 3"), df.filter("event_id > 3 and event_id < 6"), df.filter("event_id >= 6")], "n")
    stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
              .withColumn("ts", F.col("ts").cast("timestamp")))
    out = scratch_path(spark, "notices")
    streams.run_available_now(streams.stream_presence(stream).writeStream.format("parquet"), "t-k4n", spark, out)
    assert rows(spark.read.parquet(out), "event_id", "delta", "notice") == [
        (1, 1, None), (2, 1, None), (3, 0, "player-joined"), (4, -1, "player-left"), (5, -1, None), (6, 0, None)]


def test_damaged_history_is_an_error(spark):
    import os

    import pytest
    root = scratch_path(spark, "hist")
    assert streams._read_previous(spark, root, 3) is None
    spark.createDataFrame([(1,)], "a long").write.parquet(f"{root}/batch_id=0")
    assert streams._read_previous(spark, root, 3).count() == 1
    for d, _, files in os.walk(root):
        for f in files:
            if f.endswith(".parquet"):
                with open(os.path.join(d, f), "wb") as w:
                    w.write(b"damaged")
    with pytest.raises(Exception):
        streams._read_previous(spark, root, 3).count()


def event_batches(spark, n, cuts, lobbies=1):
    """``n`` events in batches that end before each of ``cuts``; some of the last batch come late."""
    kinds = ["requestJoin", "chat-message", "requestJoin", "disconnect", "requestJoin", "chat-message"]
    ev = [(i, T0 + dt.timedelta(minutes=i), (i * i) % 11, kinds[(i * 5 + i // 7) % 6], f"L{i % lobbies}") for i in range(n)]
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, kind string, lobby string")
    frames = [df.filter(f"event_id >= {a} and event_id < {b}") for a, b in zip([0, *cuts], [*cuts, n])]
    src = _write_batches(spark, frames, "ev")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    return df, stream


def test_hot_lobby_by_the_fold_of_each_batch(spark):
    for lobbies in (1, 4):
        df, stream = event_batches(spark, 300, [1, 40, 40, 200], lobbies)
        out, state = scratch_path(spark, "hot"), scratch_path(spark, "hot-state")
        streams.run_available_now(carried.stream_lobby_pairs(stream, out, state, num_partitions=6), "t-hot", spark)
        cols = ("lobby", "group_no", "player1", "player2", "event_id")
        assert rows(spark.read.parquet(out), *cols) == rows(sessions.lobby_pairs(df), *cols)
        last = spark.read.parquet(f"{state}/batch_id=4")
        assert rows(last, "lobby", "waiter") == rows(sessions.lobby_waiting(df), "lobby", "waiting_player")


def test_lobby_fold_spreads_one_lobby(spark):
    df, _ = event_batches(spark, 300, [100])
    fold = sessions.lobby_fold(df, num_partitions=24)
    spread = [r["n"] for r in fold.filter("row_kind = 'pair'").groupBy("pid").agg(F.count("*").alias("n")).collect()]
    assert len(spread) > 12 and max(spread) <= 3 * sum(spread) / 24


def test_gauge_and_recipients_over_batches(spark):
    df, stream = event_batches(spark, 240, [3, 90, 91])
    out, state = scratch_path(spark, "conn"), scratch_path(spark, "conn-state")
    streams.run_available_now(carried.stream_connections(stream, out, state, connect="requestJoin"), "t-conn", spark)
    got = spark.read.parquet(out)
    want = sessions.concurrency_timeline(df, connect="requestJoin")
    assert rows(got, "event_id", "connected") == rows(want, "event_id", "connected")
    want = sessions.chat_recipients(df, connect="requestJoin")
    assert rows(got.filter("kind = 'chat-message'"), "event_id", "recipients") == rows(want, "event_id", "recipients")


def test_lost_state_is_an_error(spark):
    import pytest
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        carried.carried(spark, scratch_path(spark, "gone"), 3, spark.range(1).schema).collect()


ANSWER_SCHEMA = "game_id int, user_id int, answer_id int, round_no int, right_wrong boolean, answered_at timestamp_ntz"


def answer_batches(spark, batches):
    frames = [spark.createDataFrame(b, ANSWER_SCHEMA) for b in batches]
    src = _write_batches(spark, frames, "ans")
    return spark.readStream.schema(ANSWER_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def test_first_answers_by_arrival_with_exact_state(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    truth = spark.createDataFrame([(1, 0, True), (2, 0, False)], "answer_id int, question_id int, right_wrong boolean")
    stream = answer_batches(spark, [
        [(1, 1, 1, 1, False, at(9)), (1, 1, 2, 1, True, at(8)), (2, 1, 1, None, True, at(5)), (2, 1, 1, None, True, at(5)), (3, 1, 7, 1, True, at(1))],
        [(1, 1, 1, 1, False, at(1)), (3, 1, 1, 1, False, at(30)), (3, 1, 1, 1, False, at(30)), (4, 1, None, 1, False, at(30))]])
    sink = scratch_path(spark, "first")
    streams.run_available_now(keyed.write_first_answers(keyed.stream_first_answers(stream, truth), sink), "t-first", spark)
    seen = spark.read.parquet(sink)
    got = rows(seen.filter("accepted = 'true'"), "batch_id", "game_id", "round_no", "answer_id", "right_wrong", "n")
    # the earlier answer of batch 1 comes too late; the unknown one of batch 0 has not taken the key
    assert got == [(0, 1, 1, 2, False, 2), (0, 2, None, 1, True, 2), (1, 3, 1, 1, True, 2)]
    assert rows(seen.filter("accepted = 'false'"), "batch_id", "game_id", "n") == [(1, 1, 3)]


def test_first_answers_within_a_watermark(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    truth = spark.createDataFrame([(1, 0, True)], "answer_id int, question_id int, right_wrong boolean")
    row = lambda g, r, m: (g, 1, 1, r, False, at(m))
    stream = answer_batches(spark, [[row(1, 1, 0), row(2, 1, 0), row(5, None, 0), row(5, None, 0)], [row(1, 1, 9), row(9, 1, 100)], [row(9, 2, 101)], [row(2, 1, 102), row(9, 1, 103)]])
    out = scratch_path(spark, "within")
    w = keyed.stream_first_answers_within(stream, truth, "10 minutes")
    streams.run_available_now(w.writeStream.format("parquet").outputMode("append"), "t-within", spark, out)
    got = rows(spark.read.parquet(out).withColumn("m", F.expr("CAST(minute(answered_at) + 60 * hour(answered_at) AS INT)")), "game_id", "round_no", "m")
    # game 1 comes again inside the delay and is dropped, game 2 beyond it and is taken again
    assert got == sorted([(1, 1, 0), (2, 1, 0), (5, None, 0), (5, None, 0), (9, 1, 100), (9, 2, 101), (2, 1, 102)], key=lambda t: tuple((x is None, str(x)) for x in t))


def test_timers_give_every_timeout(spark):
    import random
    rng = random.Random(6)
    ev = [(i, T0 + dt.timedelta(minutes=i + rng.randrange(-20, 20)), rng.randrange(4), rng.choice(["requestJoin", "answer", "page"])) for i in range(300)]
    ev += [(900, T0 + dt.timedelta(minutes=5), 77, "requestJoin"), (901, T0 + dt.timedelta(minutes=5), 77, "answer")]  # answered at once
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, kind string")
    beat = spark.createDataFrame([(None, T0 + dt.timedelta(days=3), None, None)], df.schema)
    cuts = [0, 90, 200, 1000]
    frames = [df.filter(f"event_id >= {a} and event_id < {b}") for a, b in zip(cuts, cuts[1:])]
    src = _write_batches(spark, [*frames, beat], "req")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    t = keyed.stream_timeouts(stream, F.coalesce(F.col("kind") == "requestJoin", F.lit(False)), F.coalesce(F.col("kind") == "answer", F.lit(False)), 600, "20 hours")
    out = scratch_path(spark, "timers")
    streams.run_available_now(t.writeStream.format("parquet").outputMode("append"), "t-timers", spark, out)
    want = sessions.join_request_timeouts(df.filter("kind = 'requestJoin'"), df.filter("kind = 'answer'"), "10 minutes")
    assert rows(spark.read.schema(t.schema).parquet(out), "user_id", "event_id") == rows(want, "user_id", "event_id")


def test_state_is_called_for_buckets_and_keeps_nulls(spark):
    """Thousands of sockets are a few keyed rows of state; NULL sockets and ids stay NULL, large ids exact."""
    big = (1 << 60) + 1
    ev = [(big + i, T0 + dt.timedelta(seconds=i), big + i % 2000, "connect" if i < 2000 else "disconnect") for i in range(3000)]
    ev += [(None, T0, None, "connect"), (7, T0 + dt.timedelta(days=1), None, "disconnect")]
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, kind string")
    src = _write_batches(spark, [df.filter(F.col("kind") == "connect"), df.filter(F.col("kind") == "disconnect")], "b")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "buckets")
    q = streams.run_available_now(streams.stream_presence(stream, buckets=8).writeStream.format("parquet"), "t-k4b", spark, out)
    got = spark.read.parquet(out)
    assert rows(got, "event_id", "user_id", "kind", "delta") == rows(df.withColumn("delta", F.when(F.col("kind") == "connect", 1).otherwise(-1)), "event_id", "user_id", "kind", "delta")
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
