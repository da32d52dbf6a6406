"""Constraint checks and the reference's sample reports on tiny reference-shaped rows."""
import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from quizmart.operators import quality, reports

T0 = dt.datetime(2024, 1, 1)


def _quiz(spark):
    courses = spark.createDataFrame([(1, "Mathe"), (2, "Mathe"), (3, "Leer")], "course_id int, course_name string")
    questions = spark.createDataFrame([(10, 1, "approved"), (11, 1, "pending"), (12, 2, "approved")],
                                      "question_id long, course_id int, status string")
    users = spark.createDataFrame([(31, "pirate_max", 31), (32, "anna", None), (33, "x", 99)],
                                  "user_id long, username string, avatar_id int")
    games = spark.createDataFrame([(1, 1, "finished"), (2, 2, "active"), (3, 99, "waiting")],
                                  "game_id long, course_id int, status string")
    ga = spark.createDataFrame([
        (1, 31, 1, True), (1, 31, 2, True), (1, 31, 3, None), (1, 31, 4, False), (2, 32, 1, True),
        (3, 31, 1, True), (9, 31, 1, True)],
        "game_id long, user_id long, round_no int, right_wrong boolean")
    return courses, questions, users, games, ga


def test_reports(spark):
    courses, questions, users, games, ga = _quiz(spark)
    # same-named courses stay apart; empty course counts 0
    assert rows(reports.course_question_counts(courses, questions)) == [(1, "Mathe", 2), (2, "Mathe", 1), (3, "Leer", 0)]
    assert rows(reports.course_question_counts(courses, questions, status="approved"), "course_id", "question_count") == [
        (1, 1), (2, 1), (3, 0)]
    # answers of game 3 (unknown course) and game 9 (unknown game) drop out; NULL right counts 0
    assert rows(reports.quiz_results(users, ga, games, courses)) == [("anna", 2, "Mathe", 1, 1),
                                                                     ("pirate_max", 1, "Mathe", 4, 2)]
    assert rows(reports.quiz_results(users, ga, games, courses, user_id=31)) == [("pirate_max", 1, "Mathe", 4, 2)]
    assert rows(reports.user_scores(ga, games)) == [(31, 30), (32, 10)]
    avatars = spark.createDataFrame([(31, "Pirat Pete")], "avatar_id int, avatar_name string")
    assert rows(reports.users_with_avatars(users, avatars), "user_id", "avatar_name") == [(31, "Pirat Pete")]


def test_quality(spark):
    courses, questions, users, games, ga = _quiz(spark)
    nn = quality.violations_not_null(users, ["avatar_id", "username"])
    assert rows(nn, "user_id", "rule") == [(32, "not_null(avatar_id)")]
    dup = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "k long, v string")
    assert rows(quality.violations_unique(dup, ["k"]), "v") == [("a",), ("b",)]
    fk = quality.violations_fk(games, "course_id", courses, "course_id")
    assert rows(fk, "game_id") == [(3,)]
    st = spark.createDataFrame([(1, "bogus"), (2, None), (3, "active")], "id long, status string")
    assert rows(quality.violations_domain(st, "status", ["waiting", "active", "finished"]), "id") == [(1,)]
    assert rows(quality.violations_length(st, "status", 5), "id") == [(3,)]
    d = quality.apply_defaults(st, {"status": "x", "score": 0})
    assert rows(d, "id", "status", "score") == [(1, "bogus", 0), (2, None, 0), (3, "active", 0)]
    keys = quality.assign_surrogate_key(st, "new_id", ["id"], existing=games, existing_key="game_id")
    assert rows(keys, "id", "new_id") == [(1, 4), (2, 5), (3, 6)]


def test_rounds_alignment_and_approval(spark):
    # global round serials 7, 8, 9 for game 1 and 3 for game 2; answers count rounds 1.. per game
    rounds = spark.createDataFrame([(7, 1, 100), (8, 1, 101), (9, 1, 102), (3, 2, 103)],
                                   "round_no long, game_id long, question_id long")
    answers = spark.createDataFrame([(1, 100), (2, 101), (3, 999), (4, 103)], "answer_id long, question_id long")
    ga = spark.createDataFrame([(1, 31, 1, 1), (1, 31, 2, 2), (1, 31, 3, 3), (2, 32, 1, 4)],
                               "game_id long, user_id long, round_no int, answer_id long")
    al = quality.align_rounds(rounds, ga, answers)
    assert rows(al, "game_id", "round_no", "round_serial", "question_match") == [
        (1, 1, 7, True), (1, 2, 8, True), (1, 3, 9, False), (2, 1, 3, True)]
    naive = ga.join(rounds, ["game_id", "round_no"])
    assert naive.count() == 0  # the trap: joining on round_no matches nothing here
    qs = spark.createDataFrame([(100, "approved"), (101, "pending"), (103, "approved")], "question_id long, status string")
    assert rows(quality.unapproved_in_play(rounds, qs), "round_no") == [(8,), (9,)]
    assert rows(quality.playable_questions(qs, rounds), "question_id") == [(100,), (103,)]
    shape = quality.violations_quiz_shape(
        spark.createDataFrame([(1, "finished")], "game_id long, status string"), rounds,
        qs.select("question_id"), spark.createDataFrame([(1, 100, True), (2, 100, True)],
                                                        "answer_id long, question_id long, right_wrong boolean"),
        spark.createDataFrame([(1, u) for u in range(6)], "game_id long, user_id long"))
    got = rows(shape, "rule", "entity_id", "n")
    assert ("rounds_per_finished_game", 1, 3) in got and ("players_per_game", 1, 6) in got
    assert ("answers_per_question", 100, 2) in got and ("one_right_answer", 100, 2) in got
    assert ("answers_per_question", 101, 0) in got
