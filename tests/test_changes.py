"""Trigger semantics as set operations: NULL edges of the status rules, scoring, duplicates, audit."""
import datetime as dt

from conftest import rows
from quizmart.operators import changes

NOW = "2024-02-01 00:00:00"
T0 = dt.datetime(2024, 1, 1)
NOWDT = dt.datetime(2024, 2, 1)


def test_score_answers_unknown_and_null(spark):
    answers = spark.createDataFrame([(1, 10, True), (2, 10, False)], "answer_id long, question_id long, right_wrong boolean")
    ga = spark.createDataFrame([(1, 1, 1, 1, False), (2, 1, 1, 2, True), (3, 1, 1, 99, True), (4, 1, 1, None, True)],
                               "game_answer_id long, game_id long, user_id long, answer_id long, right_wrong boolean")
    acc, rej = changes.score_answers(ga, answers)
    assert rows(acc, "game_answer_id", "right_wrong") == [(1, True), (2, False)]  # supplied value overridden
    assert rows(rej, "game_answer_id", "reason") == [(3, "unknown_answer"), (4, "unknown_answer")]


def test_duplicates_null_keys_exact_copies_existing(spark):
    schema = "game_id long, user_id long, round_no int, answered_at timestamp_ntz, answer_id long"
    inc = spark.createDataFrame([
        (1, 1, 1, T0, 5), (1, 1, 1, T0, 5), (1, 1, 1, T0 + dt.timedelta(1), 6),   # exact copy of the first + a later one
        (1, None, 1, T0, 7), (1, None, 1, T0, 7),                               # NULL key part: never duplicates
        (2, 1, 1, T0, 8)], schema)                                               # key already stored
    existing = spark.createDataFrame([(2, 1, 1, T0, 1)], schema)
    acc, rej = changes.duplicate_round_answers(inc, existing)
    assert rows(acc, "game_id", "user_id", "answer_id") == [(1, 1, 5), (1, None, 7), (1, None, 7)]
    assert rows(rej, "answer_id", "reason") == [(5, "duplicate_in_batch"), (6, "duplicate_in_batch"),
                                                (8, "duplicate_existing")]


def test_game_status_rules(spark):
    games = spark.createDataFrame([
        (1, "waiting", None, None), (2, "waiting", None, None), (3, "active", T0, None), (4, "finished", T0, T0),
        (5, None, None, None), (6, "waiting", None, None), (7, "active", T0, None), (8, "waiting", T0, None)],
        "game_id long, status string, start_date timestamp_ntz, finish_date timestamp_ntz")
    chg = spark.createDataFrame([(1, "active"), (2, "finished"), (3, "waiting"), (4, "active"), (5, "bogus"),
                                 (6, None), (7, "finished"), (8, "active")], "game_id long, status string")
    snap, dec, rej = changes.apply_game_status(games, chg, NOW)
    got = {r["old_game_id"]: (r["reason"], r["new_start_date"], r["new_finish_date"]) for r in dec.collect()}
    assert got[1] == (None, NOWDT, None)            # waiting -> active stamps start
    assert got[2] == (None, None, NOWDT)            # waiting -> finished stamps only finish
    assert got[3][0] == "transition"                # active -> waiting
    assert got[4][0] == "finished_is_final"         # finished -> active
    assert got[5][0] == "domain"                    # OLD NULL: unchecked, then CHECK fails
    assert got[6][0] is None                        # NEW NULL passes (three-valued logic)
    assert got[7] == (None, T0, NOWDT)
    assert got[8] == (None, T0, None)               # start_date already set: kept
    assert snap.count() == 8
    assert dict(rows(snap, "game_id", "status"))[3] == "active"  # rejected change keeps the old row


def test_question_review(spark):
    q = spark.createDataFrame([(1, "pending", None), (2, "pending", 7), (3, "approved", None)],
                              "question_id long, status string, checked_by_adminid long")
    chg = spark.createDataFrame([(1, "approved"), (2, "rejected"), (3, "rejected")], "question_id long, status string")
    _snap, dec, _rej = changes.apply_question_review(q, chg, NOW)
    got = {r["old_question_id"]: (r["reason"], r["new_check_date"]) for r in dec.collect()}
    assert got == {1: ("admin_required", NOWDT), 2: (None, NOWDT), 3: (None, None)}


def test_audit_diff_and_patch(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "id long, name string, v long")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 2), (4, "d", None)], "id long, name string, v long")
    a = changes.audit_diff(old, new, ["id"], "t", NOW)
    assert rows(a, "id", "operation") == [(2, "UPDATE"), (3, "DELETE"), (4, "INSERT")]
    ins = [r for r in a.collect() if r["operation"] == "INSERT"][0]
    assert ins["new_values"] == '{"id":4,"name":"d","v":null}' and ins["old_values"] is None
    prof = spark.createDataFrame([(1, "u1", "e1", "pw1"), (2, "u2", "e2", "pw2")],
                                 "user_id long, username string, email string, password string")
    patch = spark.createDataFrame([(1, "", None, "")], "user_id long, username string, email string, password string")
    out = rows(changes.patch_profile(prof, patch, "user_id", ["username", "email", "password"]))
    assert out == [(1, "", "e1", "pw1"), (2, "u2", "e2", "pw2")]


def test_set_status_and_scores(spark):
    df = spark.createDataFrame([(1, "pending"), (2, "pending")], "id long, status string")
    upd = spark.createDataFrame([(1, "approved", 1), (1, "rejected", 2), (9, "approved", 1)],
                                "id long, status string, ts long")
    assert rows(changes.set_status(df, upd, "id"), "id", "status") == [(1, "rejected"), (2, "pending")]
    groups = spark.createDataFrame([(1, 31, 85), (2, 34, 88)], "game_id long, user_id long, score int")
    scores = spark.createDataFrame([(31, 40)], "user_id long, score long")
    assert rows(changes.refresh_group_scores(groups, scores), "user_id", "score") == [(31, 40), (34, 88)]


def test_retention_and_erasure(spark):
    log = spark.createDataFrame([(1, dt.datetime(2024, 1, 31, 12)), (2, dt.datetime(2024, 1, 20)),
                                 (3, dt.datetime(2023, 12, 1))], "id long, ts timestamp_ntz")
    assert rows(changes.retention_tier(log, "2024-02-01 00:00:00"), "id", "tier") == [
        (1, "direct"), (2, "backup"), (3, "delete")]
    ids = spark.createDataFrame([(5,)], "user_id long")
    q = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "question_id long, made_by_userid long")
    assert rows(changes.erase_users(q, ids, null_cols=["made_by_userid"])) == [(1, None), (2, 6), (3, None)]


def test_first_per_key_large_group_of_copies(spark):
    schema = "k long, t long, v string"
    data = [(1, 5, "x")] * 1000 + [(1, 9, "y")] * 3 + [(2, 1, "z")] + [(3, 1, "w")] * 20
    df = spark.createDataFrame(data, schema)
    firsts, rest = changes.first_per_key(df, ["k"], ["t"])
    assert rows(firsts) == [(1, 5, "x"), (2, 1, "z"), (3, 1, "w")]
    counts = {}
    for r in rest.collect():
        counts[tuple(r)] = counts.get(tuple(r), 0) + 1
    assert counts == {(1, 5, "x"): 999, (1, 9, "y"): 3, (3, 1, "w"): 19}


def test_prune_existing_gives_same_decisions(spark):
    schema = "game_id long, user_id long, round_no int, answered_at timestamp_ntz, answer_id long"
    inc = spark.createDataFrame([(1, 1, 1, T0, 5), (1, 1, 2, T0, 6), (2, 2, 1, T0, 7), (3, None, 1, T0, 8)], schema)
    existing = spark.createDataFrame([(1, 1, 1, T0, 1), (9, 9, 9, T0, 2), (3, None, 1, T0, 3)], schema)
    a1, r1 = changes.duplicate_round_answers(inc, existing)
    a2, r2 = changes.duplicate_round_answers(inc, existing, prune_existing=True)
    assert rows(a1) == rows(a2) and rows(r1) == rows(r2)
    assert rows(r1, "answer_id", "reason") == [(5, "duplicate_existing")]


def test_set_status_keeps_the_reason_of_untouched_rows(spark):
    df = spark.createDataFrame([(1, "rejected", "spam"), (2, "pending", None)], "id long, status string, reason string")
    upd = spark.createDataFrame([(2, "rejected", "rude", T0)], "id long, status string, reason string, ts timestamp_ntz")
    assert rows(changes.set_status(df, upd, "id")) == [(1, "rejected", "spam"), (2, "rejected", "rude")]


def test_several_changes_of_one_key(spark):
    games = spark.createDataFrame([(1, "waiting", None, None), (2, "active", T0, None)],
                                  "game_id long, status string, start_date timestamp_ntz, finish_date timestamp_ntz")
    chg = spark.createDataFrame([(1, "active", 1), (1, "finished", 2), (2, "finished", 1)], "game_id long, status string, n int")
    snap, dec, rej = changes.apply_game_status(games, chg, "2024-02-01 00:00:00", order=["n"])
    assert rows(snap, "game_id", "status") == [(1, "active"), (2, "finished")]
    assert rows(dec, "old_game_id", "new_status", "reason") == [(1, "active", None), (1, "finished", "duplicate_change"), (2, "finished", None)]
    assert rows(rej, "old_game_id") == [(1,)]
    users = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "user_id long, username string, password string")
    pat = spark.createDataFrame([(1, "c", "", 1), (1, None, "p", 2), (1, "d", "", 3)], "user_id long, username string, password string, n int")
    assert rows(changes.patch_profile(users, pat, "user_id", ["username", "password"], order=["n"])) == [(1, "d", "p"), (2, "b", "y")]
    t = changes.touch_updated_at(users, pat.select("user_id", "username", "n"), "user_id", "2024-02-01 00:00:00", order=["n"])
    assert rows(t, "user_id", "username") == [(1, "d")]


def test_erase_everywhere(spark):
    a = spark.createDataFrame([(1, 2), (2, 3)], "user_id long, v long")
    b = spark.createDataFrame([(7, 2), (8, 3)], "id long, author long")
    out = changes.erase_everywhere({"a": (a, "user_id", []), "b": (b, None, ["author"])}, spark.createDataFrame([(2,)], "user_id long"))
    assert rows(out["a"]) == [(1, 2)] and rows(out["b"], "id", "author") == [(7, None), (8, 3)]
