"""Sessions and lobby pairing against straightforward sequential folds."""
import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import rows
from quizmart.operators import sessions

T0 = dt.datetime(2024, 1, 1)


def _events(n, lobbies, seed, sockets=12):
    rnd = random.Random(seed)
    kinds = ["requestJoin"] * 5 + ["disconnect"] * 2 + ["page"]
    out = []
    for i in range(n):
        lobby = "L0" if rnd.random() < 0.6 else f"L{rnd.randint(1, lobbies)}"  # one hot lobby
        out.append((i, T0 + dt.timedelta(seconds=rnd.randint(0, 50_000)), rnd.randint(1, sockets),
                    rnd.choice(kinds), lobby))
    return out


def _fold(events, allow_self, finals=None):
    by = {}
    for e in sorted(events, key=lambda e: (e[4], e[1], e[0])):
        by.setdefault(e[4], []).append(e)
    out = []
    for lobby, evs in sorted(by.items()):
        waiter, g = None, 0
        for eid, ts, s, kind, _ in evs:
            if kind == "requestJoin":
                if waiter is None:
                    waiter = s
                elif waiter == s and not allow_self:
                    pass
                else:
                    g += 1
                    out.append((lobby, g, waiter, s, eid))
                    waiter = None
            elif kind == "disconnect" and waiter == s:
                waiter = None
        if finals is not None:
            finals[lobby] = waiter
    return sorted(out, key=str)


def test_lobby_pairs_hot_lobby_many_partitions(spark):
    ev = _events(2500, 6, seed=11)
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, kind string, lobby string")
    for allow in (False, True):
        got = sessions.lobby_pairs(df, allow_self_pair=allow, num_partitions=24)
        got_rows = sorted(rows(got, "lobby", "group_no", "player1", "player2", "event_id"), key=str)
        finals = {}
        assert got_rows == _fold(ev, allow, finals)
        waiting = dict(rows(sessions.lobby_waiting(df, allow_self_pair=allow, num_partitions=24)))
        assert waiting == finals


def test_lobby_waiter_disconnect_and_self_queue(spark):
    ev = [(1, T0, 7, "requestJoin", "L"), (2, T0 + dt.timedelta(seconds=1), 7, "requestJoin", "L"),
          (3, T0 + dt.timedelta(seconds=2), 7, "disconnect", "L"), (4, T0 + dt.timedelta(seconds=3), 8, "requestJoin", "L"),
          (5, T0 + dt.timedelta(seconds=4), 9, "requestJoin", "L")]
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, kind string, lobby string")
    got = rows(sessions.lobby_pairs(df), "group_no", "player1", "player2")
    assert got == [(1, 8, 9)]  # 7 queued twice (ignored), then left; 8 and 9 pair


def test_presence_and_timeline(spark):
    ev = [(1, T0, 1, "connect"), (2, T0 + dt.timedelta(seconds=1), 1, "connect"),
          (3, T0 + dt.timedelta(seconds=2), 2, "connect"), (4, T0 + dt.timedelta(seconds=3), 1, "chat-message"),
          (5, T0 + dt.timedelta(seconds=4), 1, "disconnect"), (6, T0 + dt.timedelta(seconds=5), 1, "disconnect"),
          (7, T0 + dt.timedelta(seconds=6), 2, "chat-message"), (8, T0 + dt.timedelta(seconds=7), 3, "requestJoin"),
          (9, T0 + dt.timedelta(seconds=8), 2, "join-chat")]
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, kind string")
    iv = rows(sessions.presence_intervals(df), "user_id", "open_event_id", "close_event_id")
    assert iv == [(1, 1, 5), (2, 3, None)]
    tl = dict(rows(sessions.concurrency_timeline(df), "event_id", "connected"))
    assert tl == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1}
    rc = rows(sessions.chat_recipients(df), "event_id", "recipients")
    assert rc == [(4, 1), (7, 0)]


def test_join_request_timeouts(spark):
    ev = spark.createDataFrame(
        [(1, T0, 1, "requestJoin"), (2, T0 + dt.timedelta(seconds=5), 1, "answer"),
         (3, T0, 2, "requestJoin"), (4, T0 + dt.timedelta(seconds=11), 2, "answer"),
         (5, T0 + dt.timedelta(seconds=20), 3, "requestJoin"), (6, T0 + dt.timedelta(seconds=20), 3, "answer")],
        "event_id long, ts timestamp_ntz, user_id long, kind string")
    out = sessions.join_request_timeouts(ev.filter("kind = 'requestJoin'"), ev.filter("kind = 'answer'"), "10 seconds")
    assert rows(out, "event_id") == [(3,)]


def test_coin_sessions_and_totals(spark):
    ev = spark.createDataFrame(
        [(1, T0, 1, "answer", 2), (2, T0 + dt.timedelta(seconds=1), 1, "page", 3),
         (3, T0 + dt.timedelta(seconds=2), 1, "answer", 2), (4, T0 + dt.timedelta(seconds=3), 1, "answer", 2),
         (5, T0 + dt.timedelta(seconds=4), 1, "answer", 4), (6, T0 + dt.timedelta(seconds=5), 1, "answer", 1)],
        "event_id long, ts timestamp_ntz, user_id long, kind string, k int")
    s = sessions.coin_sessions(ev, (F.col("kind") == "page") & (F.col("k") < 20))
    assert dict(rows(s, "event_id", "session_id")) == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    c = sessions.coin_totals(s, F.col("kind") == "answer", F.col("k"), F.col("k") % 2 == 0)
    assert rows(c, "session_id", "coins") == [(0, 1), (1, 2)]  # question 2 only once per session


def test_first_registration_wins(spark):
    users = spark.createDataFrame([(5, "anna"), (9, "Bob")], "user_id long, username string")
    req = spark.createDataFrame([(1, T0, "bob"), (2, T0, "anna"), (3, T0 + dt.timedelta(seconds=1), "bob"),
                                 (4, T0 + dt.timedelta(seconds=2), "carl")], "event_id long, ts timestamp_ntz, username string")
    acc, rej = sessions.first_registration_wins(req, users)
    assert rows(acc, "event_id", "username", "user_id") == [(1, "bob", 10), (4, "carl", 11)]
    assert rows(rej, "event_id", "reason") == [(2, "username_taken"), (3, "duplicate_in_batch")]


def test_timeline_hot_socket_many_partitions(spark):
    rnd = random.Random(5)
    kinds = ["connect", "disconnect", "chat-message", "page"]
    ev = [(i, T0 + dt.timedelta(seconds=i), 1 if rnd.random() < 0.5 else rnd.randint(2, 9), rnd.choice(kinds))
          for i in range(3000)]
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, kind string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        tl = dict(rows(sessions.concurrency_timeline(df), "event_id", "connected"))
        rc = dict(rows(sessions.chat_recipients(df), "event_id", "recipients"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    open_, want_tl, want_rc = set(), {}, {}
    for eid, _ts, s, k in ev:
        if k == "connect":
            open_.add(s)
        elif k == "disconnect":
            open_.discard(s)
        want_tl[eid] = len(open_)
        if k == "chat-message":
            want_rc[eid] = len(open_) - (1 if s in open_ else 0)
    assert tl == want_tl and rc == want_rc


def test_lobby_pairs_null_lobby(spark):
    ev = _events(600, 2, seed=21)
    ev = [(e[0], e[1], e[2], e[3], None if e[4] == "L0" else e[4]) for e in ev]
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, kind string, lobby string")
    got = sorted(rows(sessions.lobby_pairs(df, num_partitions=12), "lobby", "group_no", "player1", "player2",
                      "event_id"), key=str)
    want = _fold([(a, b, c, d, e if e is not None else "~") for a, b, c, d, e in ev], False)
    want = sorted([(None if w[0] == "~" else w[0],) + tuple(w[1:]) for w in want], key=str)
    assert got == want


def test_lobby_passes_hold_no_partition(spark, monkeypatch):
    """A partition of one lobby goes through both passes batch by batch: what is sent on is bounded."""
    import numpy as np
    import pandas as pd
    import pyspark
    monkeypatch.setattr(pyspark, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 0)}))}))
    taken = []

    def batches():
        for b in range(40):
            taken.append(b)
            n = np.arange(b * 1000, (b + 1) * 1000)
            yield pd.DataFrame({"lobby": "L", "user_id": n % 1009, "kind": "requestJoin", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(n, "s"),
                                "event_id": n, "__offset": np.nan, "__incoming": np.nan})

    out, sizes, seen = sessions._emit_pairs("lobby", "user_id", False)(batches()), [], []
    for pdf in out:
        sizes.append(len(pdf))
        seen.append(len(taken))
    assert sum(sizes) == 20_001 and len(sizes) > 1 and max(sizes) < 2 * sessions.EMIT_ROWS and seen[0] < 40
    (row,) = next(iter(sessions._summarize_lobbies("lobby", "user_id", False)(batches()))).to_dict("records")
    assert row["a_n"] == 20_000 and row["c_n"] == 20_000 and row["s1"] == 0 and row["c_out"] == 39_999 % 1009


def test_ordered_pass_of_a_middling_feed_is_split(spark):
    """48 MB of event files (60 times sf0.1) are several range partitions, of which a task sorts one."""
    from quizmart.operators import scan
    path = f"{scan.checkpoint_root(spark)}/split-feed"
    spark.range(0, 9_000_000, 1, 4).select(F.xxhash64("id").alias("event_id")).write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    assert scan.input_partitions(df) >= 4
