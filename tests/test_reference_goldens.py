"""

Fixed values: the sample database rows (only the columns these checks read), and the expected
results derived from them by reading.
"""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quizmart.operators import changes, quality, reports

USERS = [(31, "pirate_max", 31), (32, "treasure_anna", 32), (33, "sailor_tim", 33), (34, "captain_lisa", 34),
         (35, "navigator_ben", 35), (36, "mermaid_emma", 36), (37, "pirate_paul", 37), (38, "treasure_sarah", 38),
         (39, "sailor_tom", 39), (40, "captain_nina", 40)]
AVATARS = [(31, "Pirat Pete"), (32, "Kapitän Hook"), (33, "Schatzjäger Sam"), (34, "Meerjungfrau Marina"),
           (35, "Papagei Polly"), (36, "Navigator Nick"), (37, "Piratin Ruby"), (38, "Matrose Max"),
           (39, "Inselkönig Leo"), (40, "Schatzhüterin Luna")]
COURSES = [(1, "Die Haifischbucht: Mathematik"), (2, "Piratenalgebra"), (3, "Schatzgeometrie"),
           (4, "Navigationsrechnung"), (5, "Münzzählerei"), (6, "Seefahrer-Statistik"), (7, "Kanonen-Physik"),
           (8, "Insel-Geografie"), (9, "Piratenkunde"), (10, "Schiffbau-Mathematik")]
QUESTIONS = [(31, 1, "approved"), (32, 1, "approved"), (33, 2, "approved"), (34, 3, "approved"),
             (35, 4, "approved"), (36, 1, "pending"), (37, 5, "pending"), (38, 6, "approved"),
             (39, 8, "approved"), (40, 9, "approved")]
ANSWERS = [(a, 31 + (a - 41) // 4, (a - 41) % 4 == 0) for a in range(41, 81)]  # 4 per question, first one right
GAMES = [(1, 1, 31, "finished"), (2, 1, 32, "finished"), (3, 2, 33, "finished"), (4, 2, 34, "active"),
         (5, 3, 35, "waiting"), (6, 1, 36, "finished"), (7, 4, 37, "finished"), (8, 6, 38, "active"),
         (9, 8, 39, "finished"), (10, 9, 40, "waiting")]
ROUND_QUESTIONS = {1: [31, 32, 33, 34, 35], 2: [31, 32, 36, 38, 39], 3: [33, 34, 35, 31, 32],
                   6: [31, 32, 36, 38, 40], 7: [35, 38, 39, 40, 31], 9: [39, 40, 38, 31, 32]}
GAME_ANSWERS = [  # game_answer_id, game_id, user_id, answer_id, round_no, right_wrong, minute offset
    (1, 1, 31, 41, 1, True), (2, 1, 31, 45, 2, True), (3, 1, 31, 50, 3, False), (4, 1, 31, 53, 4, True),
    (5, 1, 31, 57, 5, True), (6, 2, 32, 41, 1, True), (7, 2, 32, 45, 2, True), (8, 2, 32, 61, 3, True),
    (9, 2, 32, 69, 4, True), (10, 2, 32, 73, 5, True), (11, 3, 33, 49, 1, True), (12, 3, 33, 54, 2, False),
    (13, 3, 33, 57, 3, True), (14, 3, 33, 42, 4, False), (15, 3, 33, 46, 5, False), (16, 6, 36, 41, 1, True),
    (17, 6, 36, 46, 2, False), (18, 6, 36, 61, 3, True), (19, 6, 36, 69, 4, True), (20, 6, 36, 77, 5, True),
    (21, 7, 37, 57, 1, True), (22, 7, 37, 69, 2, True), (23, 7, 37, 73, 3, True), (24, 7, 37, 77, 4, True),
    (25, 7, 37, 42, 5, False), (26, 9, 39, 73, 1, True), (27, 9, 39, 77, 2, True), (28, 9, 39, 70, 3, False),
    (29, 9, 39, 41, 4, True), (30, 9, 39, 45, 5, True)]
CHATS_GAME_1 = [(1, 31, 1, dt.datetime(2024, 3, 1, 14, 31)), (2, 32, 1, dt.datetime(2024, 3, 1, 14, 32)),
                (3, 31, 1, dt.datetime(2024, 3, 1, 14, 34)), (4, 32, 1, dt.datetime(2024, 3, 1, 14, 36)),
                (5, 33, 3, dt.datetime(2024, 3, 2, 15, 23))]
GROUP_SCORES = [(1, 31, 85), (2, 32, 92), (3, 33, 78), (4, 34, 88), (5, 35, 95), (6, 36, 82), (7, 37, 91),
                (8, 38, 76), (9, 39, 89), (10, 40, 93)]


@pytest.fixture(scope="module")
def db(spark):
    rounds, n = [], 0
    for g in sorted(ROUND_QUESTIONS):
        for q in ROUND_QUESTIONS[g]:
            n += 1
            rounds.append((n, g, q))
    return {
        "users": spark.createDataFrame(USERS, "user_id long, username string, avatar_id int"),
        "avatars": spark.createDataFrame(AVATARS, "avatar_id int, avatar_name string"),
        "courses": spark.createDataFrame(COURSES, "course_id int, course_name string"),
        "questions": spark.createDataFrame(QUESTIONS, "question_id long, course_id int, status string"),
        "answers": spark.createDataFrame(ANSWERS, "answer_id long, question_id long, right_wrong boolean"),
        "games": spark.createDataFrame(GAMES, "game_id long, course_id int, user_id long, status string"),
        "rounds": spark.createDataFrame(rounds, "round_no long, game_id long, question_id long"),
        "game_answers": spark.createDataFrame(GAME_ANSWERS, "game_answer_id long, game_id long, user_id long, "
                                                            "answer_id long, round_no int, right_wrong boolean"),
        "chats": spark.createDataFrame(CHATS_GAME_1, "chat_id long, user_id long, game_id long, time timestamp_ntz"),
        "groups": spark.createDataFrame(GROUP_SCORES, "game_id long, user_id long, score int"),
    }


def test_users_with_avatars(db):
    got = rows(reports.users_with_avatars(db["users"], db["avatars"]), "user_id", "avatar_name")
    assert len(got) == 10 and got[0] == (31, "Pirat Pete") and got[-1] == (40, "Schatzhüterin Luna")


def test_course_question_counts(db):
    got = dict(rows(reports.course_question_counts(db["courses"], db["questions"]), "course_id", "question_count"))
    assert got == {1: 3, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0, 8: 1, 9: 1, 10: 0}


def test_quiz_results_user_31(db):
    got = rows(reports.quiz_results(db["users"], db["game_answers"], db["games"], db["courses"], user_id=31))
    assert got == [("pirate_max", 1, "Die Haifischbucht: Mathematik", 5, 4)]


def test_game_chat(db):
    got = rows(reports.game_chat(db["chats"], db["users"], game_id=1), "position", "user_id", order=True)
    assert sorted(got) == [(1, 31), (2, 32), (3, 31), (4, 32)]


def test_scores_and_group_refresh(db):
    s = reports.user_scores(db["game_answers"], db["games"], 10)
    assert dict(rows(s)) == {31: 40, 32: 50, 33: 20, 36: 40, 37: 40, 39: 40}
    g = dict(rows(changes.refresh_group_scores(db["groups"], s), "user_id", "score"))
    assert g == {31: 40, 32: 50, 33: 20, 34: 88, 35: 95, 36: 40, 37: 40, 38: 76, 39: 40, 40: 93}


def test_scoring_agrees_and_no_duplicates(db):
    acc, rej = changes.score_answers(db["game_answers"], db["answers"])
    stored = dict(rows(db["game_answers"], "game_answer_id", "right_wrong"))
    assert dict(rows(acc, "game_answer_id", "right_wrong")) == stored and rej.count() == 0
    assert quality.violations_unique(db["game_answers"], ["game_id", "user_id", "round_no"]).count() == 0


def test_rounds_alignment_and_unapproved(db):
    al = quality.align_rounds(db["rounds"], db["game_answers"], db["answers"])
    assert al.count() == 30 and al.filter(~F.col("question_match")).count() == 0
    assert db["game_answers"].join(db["rounds"], ["game_id", "round_no"]).count() == 5  # the naive join
    un = rows(quality.unapproved_in_play(db["rounds"], db["questions"]), "game_id", "question_id")
    assert un == [(2, 36), (6, 36)]


def test_constraints_hold(db):
    assert quality.violations_fk(db["rounds"], "question_id", db["questions"], "question_id").count() == 0
    assert quality.violations_fk(db["game_answers"], "answer_id", db["answers"], "answer_id").count() == 0
    assert quality.violations_domain(db["games"], "status", ["waiting", "active", "finished"]).count() == 0
    shape = quality.violations_quiz_shape(db["games"], db["rounds"], db["questions"], db["answers"],
                                          db["groups"])
    assert shape.count() == 0
