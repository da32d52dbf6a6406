"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the stand-in views of the driver tables (``quizmart.sources.standin``) and
runs a library operator over the whole tables. ``ORACLE`` in :mod:`quizmart.plans.oracle` holds
the DuckDB statement with the same column names for each key.

Operators that apply a *change set* (status changes, reviews, profile patches, erasure requests,
incoming vs. stored answers, old vs. new snapshots) need one; it is derived from the same tables
by the fixed rules of FIXTURES.md (e.g. every third game gets a new status). These rules only
define which rows a batch changes — the operators still read and rewrite the whole tables, and no
rule caps or samples rows to make a check cheaper.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizmart.operators import reports
from quizmart.sources import standin as sv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- D / E reports
@query("e2_quiz_results")
def q_quiz_results(spark, d):
    return reports.quiz_results(sv.users(spark, d), sv.game_answers(spark, d, by_game=True), sv.games(spark, d),
                                sv.courses(spark, d))


@query("e2_quiz_results_one_user")
def q_quiz_results_one_user(spark, d):
    return reports.quiz_results(sv.users(spark, d), sv.game_answers(spark, d, by_game=True), sv.games(spark, d),
                                sv.courses(spark, d), user_id=31)


@query("e1_course_question_counts")
def q_course_counts(spark, d):
    return reports.course_question_counts(sv.courses(spark, d), sv.questions(spark, d))


@query("e1_course_question_counts_approved")
def q_course_counts_approved(spark, d):
    return reports.course_question_counts(sv.courses(spark, d), sv.questions(spark, d), status="approved")


@query("d1_users_with_avatars")
def q_users_with_avatars(spark, d):
    return reports.users_with_avatars(sv.users(spark, d), sv.avatars(spark, d)).select(
        "user_id", "username", "avatar_id", "avatar_name")


@query("d2_game_chat")
def q_game_chat(spark, d):
    # Stand-in chats carry a turn number instead of a time; the conversation's number is its user.
    chats = sv.chats(spark, d).withColumnRenamed("seq", "time").drop("username").withColumn("user_id", F.col("game_id"))
    return reports.game_chat(chats, sv.users(spark, d).select("user_id", "username")).select(
        "game_id", "chat_id", "username", "text", "time", "position")


@query("e3_user_scores")
def q_user_scores(spark, d):
    return reports.user_scores(sv.game_answers(spark, d, by_game=True), sv.games(spark, d), points_per_right=10)


@query("e7_existing_answer_count")
def q_existing_answer_count(spark, d):
    return reports.existing_answer_count(sv.game_answers(spark, d, by_game=True))


# ---------------------------------------------------------------- B data quality, D8, D9
from quizmart.operators import audit, quality  # noqa: E402

NOW = "2024-02-01 00:00:00"  # the explicit "current timestamp" of every change job


def now_lit():
    return F.lit(NOW).cast("timestamp_ntz")


@query("b1_not_null_questions")
def q_not_null(spark, d):
    v = quality.violations_not_null(sv.questions(spark, d),
                                    ["question_id", "text", "course_id", "checked_by_adminid"])
    return v.select("question_id", "rule")


@query("b2_unique_answer_per_round")
def q_unique(spark, d):
    v = quality.violations_unique(sv.game_answers(spark, d, by_game=True), ["game_id", "user_id", "round_no"])
    return v.select("game_id", "user_id", "round_no", "answer_id", "tie1", "key_count", "rule")


@query("b3_fk_chats_games")
def q_fk(spark, d):
    v = quality.violations_fk(sv.chats(spark, d), "game_id", sv.games(spark, d), "game_id")
    return v.select("chat_id", "game_id", "rule")


@query("b3_fk_answers_questions")
def q_fk2(spark, d):
    v = quality.violations_fk(sv.answers(spark, d), "question_id", sv.questions(spark, d), "question_id")
    return v.select("answer_id", "question_id", "rule")


@query("b3_fk_questions_answers")
def q_fk3(spark, d):
    v = quality.violations_fk(sv.questions(spark, d).drop("text"), "question_id", sv.answers(spark, d), "question_id")
    return v.select("question_id", "status", "rule")


def game_status_changes(spark, d):
    """J1 change set (FIXTURES.md): every third game gets a new status by game_id % 4."""
    g = sv.games(spark, d).filter(F.col("game_id") % 3 == 0)
    m = F.col("game_id") % 4
    new = (F.when(m == 0, "waiting").when(m == 1, "active").when(m == 2, "finished").otherwise("bogus"))
    return g.select("game_id", new.alias("status"))


@query("b4_domain_game_status_changes")
def q_domain(spark, d):
    v = quality.violations_domain(game_status_changes(spark, d), "status", ["waiting", "active", "finished"])
    return v.select("game_id", "status", "rule")


@query("b5_length_question_text")
def q_length(spark, d):
    v = quality.violations_length(sv.questions(spark, d), "text", 500)
    return v.select("question_id", F.char_length("text").alias("n_chars"), "rule")


@query("b6_defaults_questions")
def q_defaults(spark, d):
    q = sv.questions(spark, d).select("question_id", "course_id", "checked_by_adminid")
    out = quality.apply_defaults(q, {"status": "pending", "creation_date": now_lit(),
                                     "checked_by_adminid": F.lit(-1)})
    return out.select("question_id", "course_id", "checked_by_adminid", "status", "creation_date")


@query("b7_surrogate_chat_ids")
def q_surrogate(spark, d):
    msgs = sv.events(spark, d).filter(F.col("kind") == "chat-message").select("event_id", "ts", "user_id")
    out = quality.assign_surrogate_key(msgs, "chat_id", ["ts", "event_id"], existing=sv.chats(spark, d))
    return out.select("event_id", "chat_id")


@query("b8_quiz_shape")
def q_shape(spark, d):
    return quality.violations_quiz_shape(sv.games(spark, d), sv.game_rounds(spark, d), sv.questions(spark, d),
                                         sv.answers(spark, d), day_players(spark, d))


def day_players(spark, d):
    """Players that share a game: everyone who asked to join on a day plays the day's game."""
    e = sv.events(spark, d).filter(F.col("kind") == "requestJoin")
    return e.select(F.date_format("ts", "yyyyMMdd").cast("bigint").alias("game_id"), "user_id")


@query("d8_unapproved_in_play")
def q_unapproved(spark, d):
    return quality.unapproved_in_play(sv.game_rounds(spark, d), sv.questions(spark, d)).select(
        "round_no", "game_id", "question_id")


@query("d8_playable_questions")
def q_playable(spark, d):
    return quality.playable_questions(sv.questions(spark, d), sv.game_rounds(spark, d)).select(
        "question_id", "course_id", "status")


@query("d9_align_rounds")
def q_align(spark, d):
    out = quality.align_rounds(sv.game_rounds(spark, d), sv.game_answers(spark, d), sv.answers(spark, d))
    return out.select("game_id", "user_id", "answer_id", "round_no", "round_serial", "round_question_id",
                      "answer_question_id", "question_match")


# ---------------------------------------------------------------- C screens, F1 pager
from quizmart.operators import screens  # noqa: E402


@query("c1_moderation_questions")
def q_mod_questions(spark, d):
    return screens.moderation_board(sv.questions(spark, d), " The ", "pending", ["text"],
                                    id_col="question_id", title_col="text")


def quiz_items(spark, d):
    """Quiz-moderation records from part: title, author, tags, status, createdAt text."""
    p = sv.table(spark, d, "part")
    m3, m4 = F.col("p_size") % 3, F.col("p_size") % 4
    created = F.when(m4 == 0, F.lit("not a date")).otherwise(
        F.concat(F.lit("2024-0"), (F.col("p_size") % 9 + 1).cast("string"), F.lit("-15T08:30:00")))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("title"),
                    F.col("p_brand").alias("author"), F.split("p_name", " ").alias("tags"),
                    F.when(m3 == 0, "approved").when(m3 == 1, "rejected").alias("status"),
                    created.alias("created_at"))


@query("c2_moderation_quizzes")
def q_mod_quizzes(spark, d):
    return screens.moderation_board(quiz_items(spark, d), "RED", "all", ["title", "author"], ["tags"],
                                    created_col="created_at")


@query("f1_catalogue_view")
def q_catalogue(spark, d):
    out = screens.catalogue_view(sv.courses(spark, d), sv.questions(spark, d), sv.answers(spark, d), "a")
    return out.select("course_id", "course_name", "question_id", "position", "question_total", "pager_label",
                      "has_prev", "has_next", "answer_id", "answer_text", "right_wrong", "answer_label")


@query("c13_feedback_report")
def q_feedback(spark, d):
    out = screens.feedback_report(sv.game_answers(spark, d), sv.answers(spark, d))
    return out.select("game_id", "user_id", "round_no", "answer_id", "tie1", "is_right", "right_text", "feedback")


def registration_forms(spark, d):
    c = sv.table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("form_id"),
        F.when(k % 7 == 0, F.lit(" ")).otherwise(F.substring("c_name", 1, 8)).alias("firstname"),
        F.col("c_mktsegment").alias("surname"),
        F.expr("substr(c_name, 10, CAST(c_custkey % 6 AS INT))").alias("username"),
        F.concat(F.lower("c_mktsegment"), F.lit("@example.org")).alias("email"),
        F.expr("substr(c_name, 1 + CAST(c_custkey % 5 AS INT), CAST(c_custkey % 9 AS INT))").alias("password"),
        F.concat(F.lit("avatar"), (F.col("c_nationkey") % 4).cast("string"), F.lit(".jpeg")).alias("avatar_file"))


@query("c15_registration_check")
def q_registration(spark, d):
    return screens.registration_check(registration_forms(spark, d)).select("form_id", "rule", "avatar_id")


@query("c16_profile_check")
def q_profile(spark, d):
    c = sv.table(spark, d, "customer")
    forms = c.select(
        F.col("c_custkey").alias("form_id"),
        F.expr("substr(c_name, 1, CAST(c_custkey % 12 AS INT))").alias("password"),
        F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE substr(c_name, 1, CAST(c_custkey % 12 AS INT)) END")
         .alias("confirm_password"),
        F.expr("substr(c_name, 10, CAST(c_custkey % 6 AS INT))").alias("username"))
    return screens.profile_check(forms).select("form_id", "rule")


@query("c17_submission_screen")
def q_submission(spark, d):
    p = sv.table(spark, d, "part")
    subs = p.select(
        F.col("p_partkey").alias("submission_id"), F.col("p_name").alias("text"),
        F.when(F.col("p_size") % 23 == 0, F.lit(None)).when(F.col("p_size") % 19 == 0, F.array("p_brand", "p_type", "p_name"))
         .otherwise(F.array("p_brand", "p_type", "p_name", F.when(F.col("p_size") % 5 == 0, F.lit(" "))
                            .otherwise(F.col("p_type")))).alias("answers"),
        F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(F.col("p_type")).alias("category"),
        F.when(F.col("p_size") % 11 == 0, F.lit(None)).when(F.col("p_size") % 13 == 0, F.lit(7))
         .when(F.col("p_size") % 17 == 0, F.lit(-1)).otherwise(F.col("p_size") % 4).cast("int").alias("correct"))
    out = screens.submission_screen(subs)
    texts = F.array_join(F.transform("marked", lambda m: m["text"]), " | ")
    right = (F.array_position(F.transform("marked", lambda m: m["right_wrong"]), F.lit(True)) - 1).cast("int")
    return out.select("submission_id", "rule", "status", texts.alias("marked_texts"),
                      F.when(F.col("marked").isNotNull(), right).alias("marked_right"))


@query("c10_profile_load")
def q_profile_load(spark, d):
    return screens.profile_load(sv.table(spark, d, "pages"))


# ---------------------------------------------------------------- D5, F5, J changes
from quizmart.operators import changes  # noqa: E402

TIE_ORDER = ["answered_at", "tie1", "tie2", "tie3"]
ANSWER_COLS = ["game_id", "user_id", "answer_id", "round_no", "right_wrong", "tie1", "tie2", "tie3"]


def with_unknown(game_answers):
    """Incoming answers of which every 50th answer id names no answer (D5 rejects those)."""
    a = F.col("answer_id")
    return game_answers.withColumn("answer_id", F.when(a % 50 == 49, -a).otherwise(a))


@query("d5_score_answers")
def q_score(spark, d):
    acc, rej = changes.score_answers(with_unknown(sv.game_answers(spark, d)), sv.answers(spark, d))
    return acc.withColumn("reason", F.lit(None).cast("string")).unionByName(rej).select(*ANSWER_COLS, "reason")


@query("f5_duplicate_round_answers")
def q_dups(spark, d):
    return changes.round_answer_decisions(sv.game_answers(spark, d), order=TIE_ORDER).select(*ANSWER_COLS, "reason")


def _ingest_input(spark, d):
    ga = sv.game_answers(spark, d)
    return ga.filter(F.col("tie1") % 2 == 0), with_unknown(ga.filter(F.col("tie1") % 2 == 1))


@query("j4_ingest_answers")
def q_ingest(spark, d):
    existing, incoming = _ingest_input(spark, d)
    return changes.ingest_decisions(existing, incoming, sv.answers(spark, d), TIE_ORDER).select(*ANSWER_COLS, "reason")


@query("j4_ingest_scores")
def q_ingest_scores(spark, d):
    existing, incoming = _ingest_input(spark, d)
    return changes.ingest_answers(existing, incoming, sv.answers(spark, d), sv.games(spark, d), order=TIE_ORDER)[2]


@query("j4_incremental_scores")
def q_incremental_scores(spark, d):
    """Three ingests, each adding its accepted answers' points to the stored totals: the answers
    accepted before are read for their keys only."""
    games, answers, whole = sv.games(spark, d), sv.answers(spark, d), with_unknown(sv.game_answers(spark, d))
    history, scores = scratch_path(spark, "j4-history"), scratch_path(spark, "j4-scores")
    keys = ["game_id", "user_id", "round_no"]
    total = spark.createDataFrame([], "user_id long, score long")
    for k in range(3):
        stored_keys = spark.read.parquet(*[f"{history}/{i}" for i in range(k)]).select(*keys) if k else whole.limit(0).select(*keys)
        accepted, _rejected, _delta, total = changes.ingest_delta(stored_keys, whole.filter(F.pmod(F.col("tie1"), F.lit(3)) == k), answers, games, total, TIE_ORDER)
        accepted.write.parquet(f"{history}/{k}")
        total.write.parquet(f"{scores}/{k}")
        total = spark.read.parquet(f"{scores}/{k}")
    return total


@query("j10_erase_stored_answers")
def q_erase_stored(spark, d):
    """Every fiftieth user erased from a stored table, and the files that held them deleted."""
    root = scratch_path(spark, "j10-stored")
    stored.create(sv.game_answers(spark, d), root, ["user_id"], 64)
    ids = sv.users(spark, d).filter(F.col("user_id") % 50 == 0).select("user_id")
    stored.erase_stored(spark, root, ids)
    stored.vacuum(spark, root, 1)
    return stored.read(spark, root).select(*ANSWER_COLS)


@query("j5_refresh_group_scores")
def q_refresh(spark, d):
    scores = reports.user_scores(sv.game_answers(spark, d, by_game=True), sv.games(spark, d), 10)
    return changes.refresh_group_scores(sv.game_groups(spark, d), scores)


@query("j1_apply_game_status")
def q_game_status(spark, d):
    _snap, dec, _rej = changes.apply_game_status(sv.games(spark, d), game_status_changes(spark, d), NOW)
    return dec.select(F.col("old_game_id").alias("game_id"), "old_status", "new_status", "reason",
                      "new_start_date", "new_finish_date")


@query("j1_game_snapshot")
def q_game_snapshot(spark, d):
    snap, _dec, _rej = changes.apply_game_status(sv.games(spark, d), game_status_changes(spark, d), NOW)
    return snap


from quizmart.operators import chains  # noqa: E402
from quizmart.sources import stored  # noqa: E402


@query("j1_repeated_changes")
def q_repeated_changes(spark, d):
    """Games with two changes in one set: the first applies, the second is quarantined."""
    first = game_status_changes(spark, d).withColumn("seq", F.lit(1))
    second = sv.games(spark, d).filter(F.col("game_id") % 2 == 0).select(
        "game_id", F.lit("active").alias("status"), F.lit(2).alias("seq"))
    _snap, dec, _rej = changes.apply_game_status(sv.games(spark, d), first.unionByName(second), NOW, order=["seq"])
    return dec.select(F.col("old_game_id").alias("game_id"), "old_status", "new_status", "reason")


def turn_changes(spark, d):
    """Every order line changes a game's status, a third of them that of game 1."""
    status = (F.when(F.col("l_tax") == 0.08, F.lit(None)).when(F.col("l_quantity") == 50, "bogus").when(F.col("l_returnflag") == "R", "active")
              .when(F.col("l_returnflag") == "A", "finished").otherwise("waiting"))
    return sv.table(spark, d, "lineitem").select(
        F.when(F.col("l_suppkey") % 3 == 0, F.lit(1)).otherwise(F.col("l_orderkey")).cast("bigint").alias("game_id"), status.alias("status"),
        F.col("l_shipdate").alias("changed_at"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("tie1"), F.col("l_extendedprice").alias("tie2"))


@query("j1_chained_changes")
def q_chained_changes(spark, d):
    """All changes of a game applied in turn, one game with a third of them."""
    order = ["changed_at", "seq", "tie1", "tie2"]
    _snap, dec, _rej = chains.apply_game_changes(sv.games(spark, d), turn_changes(spark, d), NOW, order)
    return dec.select(F.col("old_game_id").alias("game_id"), *order, "old_status", "new_status", "old_start_date", "new_start_date",
                      "new_finish_date", "reason")


@query("j1_chained_snapshot")
def q_chained_snapshot(spark, d):
    return chains.apply_game_changes(sv.games(spark, d), turn_changes(spark, d), NOW, ["changed_at", "seq", "tie1", "tie2"])[0]


@query("j2_chained_reviews")
def q_chained_reviews(spark, d):
    """Every event reviews a question: pages set it back, the others judge it, some without an admin."""
    e = sv.events(spark, d)
    status = F.when(F.col("kind") == "page", "pending").when(F.col("kind") == "answer", "rejected").when(F.col("kind") == "disconnect", "bogus") \
        .when(F.col("kind") == "requestJoin", F.lit(None)).otherwise("approved")
    admin = F.when(F.col("k") % 3 > 0, F.col("k") % 10)
    reviews = e.select((F.col("user_id") % 300).alias("question_id"), "ts", "event_id", status.alias("status"), admin.cast("bigint").alias("checked_by_adminid"))
    _snap, dec, _rej = chains.apply_question_reviews(sv.questions(spark, d).drop("text"), reviews, NOW, ["ts", "event_id"])
    return dec.select(F.col("old_question_id").alias("question_id"), "event_id", "old_status", "new_status", "old_checked_by_adminid", "new_check_date", "reason")


def question_review_changes(spark, d):
    q = sv.questions(spark, d).filter(F.col("question_id") % 2 == 0)
    return q.select("question_id", F.when(F.col("question_id") % 4 == 0, "approved").otherwise("rejected")
                    .alias("status"))


@query("j2_apply_question_review")
def q_review(spark, d):
    qs = sv.questions(spark, d).drop("text")
    _snap, dec, _rej = changes.apply_question_review(qs, question_review_changes(spark, d), NOW)
    return dec.select(F.col("old_question_id").alias("question_id"), "old_status", "new_status",
                      "new_checked_by_adminid", "reason", "new_check_date")


@query("j2_question_snapshot")
def q_review_snapshot(spark, d):
    snap, _dec, _rej = changes.apply_question_review(sv.questions(spark, d), question_review_changes(spark, d), NOW)
    return snap.select("question_id", "status", "check_date", "text")


@query("j3_repeated_touch")
def q_touch_repeated(spark, d):
    u = sv.users(spark, d)
    one = u.filter(F.col("user_id") % 5 == 0).select("user_id", F.upper("username").alias("username"), F.lit(1).alias("seq"))
    two = u.filter(F.col("user_id") % 10 == 0).select("user_id", F.lower("username").alias("username"), F.lit(2).alias("seq"))
    return changes.touch_updated_at(u, one.unionByName(two), "user_id", NOW, order=["seq"])


@query("j3_touch_updated_at")
def q_touch(spark, d):
    u = sv.users(spark, d)
    chg = u.filter(F.col("user_id") % 5 == 0).select("user_id", F.upper("username").alias("username"))
    return changes.touch_updated_at(u, chg, "user_id", NOW)


def moderation_updates(spark, d):
    e = sv.events(spark, d)
    st = F.when(F.col("kind") == "page", "approved").when(F.col("kind") == "answer", "rejected").otherwise("pending")
    return e.select("user_id", st.alias("status"), "ts", "event_id")


@query("j6_set_status")
def q_set_status(spark, d):
    u = quality.apply_defaults(sv.users(spark, d).select("user_id", "username"), {"status": "pending"})
    return changes.set_status(u, moderation_updates(spark, d), "user_id", tie="event_id")


def order_snapshots(spark, d):
    o = sv.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    new = (o.withColumn("o_totalprice", F.when(k % 10 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
           .withColumn("o_orderkey", F.when(k % 10 == 1, k + NEW_KEYS).otherwise(k)))
    return o, new


NEW_KEYS = 10 ** 12  # orders whose key is shifted by this are new, and their old key is gone


@query("j7_audit_diff")
def q_audit(spark, d):
    old, new = order_snapshots(spark, d)
    a = changes.audit_diff(old, new, ["o_orderkey"], "orders", NOW)
    return a.select("o_orderkey", "table_name", "operation", "user_id", "timestamp",
                    F.get_json_object("old_values", "$.o_totalprice").cast("double").alias("old_totalprice"),
                    F.get_json_object("new_values", "$.o_totalprice").cast("double").alias("new_totalprice"),
                    F.get_json_object("new_values", "$.o_orderstatus").alias("new_orderstatus"))


def profiles(spark, d):
    c = sv.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
                    F.col("c_mktsegment").alias("segment"),
                    F.concat(F.lit("pw"), F.col("c_custkey").cast("string")).alias("password"))


@query("j8_patch_profile")
def q_patch(spark, d):
    c = sv.table(spark, d, "customer").filter(F.col("c_custkey") % 3 == 0)
    k = F.col("c_custkey")
    patches = c.select(k.alias("user_id"),
                       F.when(k % 2 == 0, F.lit("")).otherwise(F.lower("c_name")).alias("username"),
                       F.when(k % 4 == 1, F.lit("VIP")).alias("segment"),
                       F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit("newpassword")).alias("password"))
    return changes.patch_profile(profiles(spark, d), patches, "user_id", ["username", "segment", "password"])


@query("j8_repeated_patches")
def q_patch_repeated(spark, d):
    c = sv.table(spark, d, "customer")
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    one = c.filter(k % 3 == 0).select(k.alias("user_id"), F.lower("c_name").alias("username"), F.lit("A").alias("segment"),
                                      F.lit("first").alias("password"), F.lit(1).alias("seq"))
    two = c.filter(k % 2 == 0).select(k.alias("user_id"), none.alias("username"), F.lit("B").alias("segment"),
                                      F.lit("").alias("password"), F.lit(2).alias("seq"))
    return changes.patch_profile(profiles(spark, d), one.unionByName(two), "user_id", ["username", "segment", "password"],
                                 order=["seq"])


@query("j9_retention_tier")
def q_retention(spark, d):
    return changes.retention_tier(sv.events(spark, d).select("event_id", "ts"), "2024-01-31 00:00:00")


def erased_users(spark, d):
    return sv.users(spark, d).filter(F.col("user_id") % 50 == 0).select("user_id")


@query("j10_erase_game_answers")
def q_erase_answers(spark, d):
    return changes.erase_users(sv.game_answers(spark, d), erased_users(spark, d)).select(
        "game_id", "user_id", "round_no", "tie1")


@query("j10_erase_question_authors")
def q_erase_questions(spark, d):
    return changes.erase_users(sv.questions(spark, d).select("question_id", "made_by_userid"),
                               erased_users(spark, d), null_cols=["made_by_userid"])


@query("j10_erase_all_tables")
def q_erase_all(spark, d):
    """Every user-keyed table in one call; rows left and references set to NULL per table."""
    out = changes.erase_everywhere({
        "users": (sv.users(spark, d).select("user_id"), "user_id", []),
        "games": (sv.games(spark, d).select("user_id"), "user_id", []),
        "game_groups": (sv.game_groups(spark, d).select("user_id"), "user_id", []),
        "game_answers": (sv.game_answers(spark, d).select("user_id"), "user_id", []),
        "events": (sv.events(spark, d).select("user_id"), "user_id", []),
        "questions": (sv.questions(spark, d).select("made_by_userid", "checked_by_adminid"), None,
                      ["made_by_userid", "checked_by_adminid"]),
    }, erased_users(spark, d))
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(df.columns[0]).isNull()).alias("n_null"))
             .select(F.lit(name).alias("table_name"), "n_rows", "n_null") for name, df in out.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


# ---------------------------------------------------------------- F sessions, D6, D7, D10, E4, E6, G3
from quizmart.operators import sessions  # noqa: E402

EVENT_COLS = ["event_id", "ts", "user_id", "kind", "k"]
OPENS = "requestJoin"  # the stand-in feed has no connect events: a join request opens the socket


def coin_events(spark, d):
    e = sv.events(spark, d)
    return sessions.coin_sessions(e, (F.col("kind") == "page") & (F.col("k") < 20))


@query("f3_coin_sessions")
def q_coin_sessions(spark, d):
    return coin_events(spark, d).select(*EVENT_COLS, "session_id")


@query("e4_coin_totals")
def q_coin_totals(spark, d):
    s = coin_events(spark, d)
    return sessions.coin_totals(s, F.col("kind") == "answer", F.col("k") % 5 + 1, F.col("k") % 2 == 0)


@query("f4_presence_intervals")
def q_presence(spark, d):
    return sessions.presence_intervals(sv.events(spark, d), connect=OPENS)


@query("f7_concurrency_timeline")
def q_timeline(spark, d):
    return sessions.concurrency_timeline(sv.events(spark, d), connect=OPENS).select(*EVENT_COLS, "connected")


@query("d7_chat_recipients")
def q_recipients(spark, d):
    return sessions.chat_recipients(sv.events(spark, d), connect=OPENS)


@query("d10_join_request_timeouts")
def q_timeouts(spark, d):
    e = sv.events(spark, d)
    return sessions.join_request_timeouts(e.filter(F.col("kind") == "requestJoin"),
                                          e.filter(F.col("kind") == "answer"), "2 hours")


def registration_requests(spark, d):
    e = sv.events(spark, d).filter(F.col("kind") == "page")
    name = F.concat(F.lit("Customer#"),
                    F.lpad(((F.col("user_id") * 13 + F.coalesce("k", F.lit(0))) % 3000).cast("string"), 9, "0"))
    return e.select("event_id", "ts", name.alias("username"))


@query("f2_first_registration_wins")
def q_registration_wins(spark, d):
    acc, rej = sessions.first_registration_wins(registration_requests(spark, d), sv.users(spark, d))
    a = acc.select("event_id", "username", "user_id", F.lit(None).cast("string").alias("reason"))
    r = rej.select("event_id", "username", F.lit(None).cast("bigint").alias("user_id"), "reason")
    return a.unionByName(r)


def login_attempts(spark, d):
    e = sv.events(spark, d).filter(F.col("kind") == "answer")
    m = F.col("k") % 10
    user = (F.when(m == 0, F.lit(" ")).when(m == 1, F.lit("admin"))
            .otherwise(F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))))
    pw = (F.when(m == 1, F.lit("admin123")).when(F.col("k") % 3 == 0, F.concat(F.lit("pw"), F.col("user_id").cast("string")))
          .otherwise(F.lit("wrong")))
    return e.select("event_id", user.alias("username"), pw.alias("password"))


def credentials(spark, d):
    c = sv.table(spark, d, "customer").select(
        F.col("c_name").alias("username"), F.sha2(F.concat(F.lit("pw"), F.col("c_custkey").cast("string")), 256)
        .alias("password_hash"))
    admin = spark.range(1).select(F.lit("admin").alias("username"),
                                  F.sha2(F.lit("admin123"), 256).alias("password_hash"))
    return c.unionByName(admin)


@query("d6_login_outcomes")
def q_login(spark, d):
    return sessions.login_outcomes(login_attempts(spark, d), credentials(spark, d)).select(
        "event_id", "username", "success", "is_admin", "message")


def lobby_events(spark, d):
    return sv.events(spark, d).withColumn("lobby", F.date_format("ts", "yyyy-MM-dd"))


@query("g3_first_requests_per_lobby")
def q_first_requests(spark, d):
    e = lobby_events(spark, d).filter(F.col("kind") == "requestJoin")
    return sessions.take_first_n_per_key(e, ["lobby"], ["ts", "event_id"], 4).select("lobby", "event_id", "user_id")


@query("f6_lobby_pairs")
def q_lobby_pairs(spark, d):
    return sessions.lobby_pairs(lobby_events(spark, d))


@query("e6_lobby_status")
def q_lobby_status(spark, d):
    return sessions.lobby_status(lobby_events(spark, d), connect=OPENS)


# ---------------------------------------------------------------- I nesting, E8, A sources, E5
from quizmart.operators import nested  # noqa: E402
from quizmart.operators.scan import input_partitions  # noqa: E402
from quizmart.session import scratch_path  # noqa: E402
from quizmart.sources import io  # noqa: E402

FLAT_COLS = ["course_id", "course_name", "page", "q_pos_in_page", "question_id", "question_text",
             "explanation", "a_pos", "answer_text", "right_wrong"]


def catalogue_pages(spark, d, answers_page_size=1000):
    return nested.nest_catalogue(sv.courses(spark, d), sv.questions(spark, d), sv.answers(spark, d), page_size=50,
                                 answers_page_size=answers_page_size)


@query("i1_i2_catalogue_roundtrip")
def q_catalogue_roundtrip(spark, d):
    return nested.flatten_catalogue(catalogue_pages(spark, d)).select(*FLAT_COLS)


@query("i2_catalogue_pages")
def q_catalogue_pages(spark, d):
    p = catalogue_pages(spark, d)
    return p.select("course_id", "course_name", "question_count", "page",
                    F.size("questions").alias("n_questions"),
                    F.expr("aggregate(questions, 0L, (acc, q) -> acc + size(q.answers))").alias("n_answers"))


@query("e8_catalogue_count_mismatch")
def q_count_mismatch(spark, d):
    approved = sv.questions(spark, d).filter(F.col("status") == "approved").groupBy("course_id").agg(
        F.count(F.lit(1)).alias("question_count"))
    pages = nested.with_declared_counts(catalogue_pages(spark, d, answers_page_size=ANSWERS_PAGE), approved)
    return nested.catalogue_count_mismatch(pages)


ANSWERS_PAGE = 3  # smaller than a question's answers, so that pages are continued


@query("i3_indexed_form")
def q_indexed(spark, d):
    a = nested.nest_in_pages(sv.answers(spark, d), ["question_id"], ["answer_id"],
                             F.struct(F.col("text"), F.col("right_wrong")), ANSWERS_PAGE, "answers")
    texts, local = nested.to_indexed_form(F.col("answers"))
    _, correct = nested.to_indexed_form(F.col("answers"), F.col("page") * ANSWERS_PAGE)
    back = nested.from_indexed_form(texts, local)
    return a.select("question_id", "page", F.array_join(texts, " | ").alias("answers_text"),
                    F.size(texts).cast("bigint").alias("n_answers"), correct.alias("correct"),
                    (back == F.transform("answers", lambda x: F.struct(
                        x["text"].alias("text"),
                        (x["right_wrong"] & (F.array_position(F.transform("answers", lambda y: y["right_wrong"]),
                                                              F.lit(True)) > 0)).alias("right_wrong"))))
                    .alias("roundtrip_ok"))


@query("i4_row_json")
def q_row_json(spark, d):
    g = sv.games(spark, d)
    j = g.select("game_id", changes.row_json(g).alias("doc"))
    return j.select("game_id", F.get_json_object("doc", "$.status").alias("status"),
                    F.size(F.json_object_keys("doc")).cast("bigint").alias("n_keys"),
                    F.col("doc").contains('"finish_date":null').alias("null_kept"))


@query("a1_copy_text_games")
def q_copy_games(spark, d):
    g = sv.games(spark, d)
    path = scratch_path(spark, "copy-games")
    io.write_copy_text(g, path)
    return io.read_copy_text(spark, path, g.schema)


@query("a1_copy_text_chats")
def q_copy_chats(spark, d):
    c = sv.chats(spark, d)
    path = scratch_path(spark, "copy-chats")
    io.write_copy_text(c, path)
    return io.read_copy_text(spark, path, c.schema)


@query("a3_catalogue_json_roundtrip")
def q_json_roundtrip(spark, d):
    path = scratch_path(spark, "catalogue-json")
    io.write_json_snapshot(catalogue_pages(spark, d), path, compression="gzip")
    return nested.flatten_catalogue(io.read_catalogue_json(spark, path)).select(*FLAT_COLS)


@query("a1_dump_block")
def q_copy_block(spark, d):
    """A dump's COPY block: header, lines (some without their last field, some with a bad number), end
    mark; fitting lines are read, the others are quarantined."""
    g = sv.games(spark, d)
    lines = io.copy_text_lines(g).withColumn("n", F.substring_index("value", "\t", 1).cast("bigint"))
    lines = lines.select(F.when(F.col("n") % 97 == 0, F.regexp_replace("value", "\t[^\t]*$", ""))
                         .when(F.col("n") % 89 == 0, F.regexp_replace("value", "^([^\t]*)\t[^\t]*", "$1\tx")).otherwise(F.col("value")).alias("value"))
    frame = spark.range(1).select(F.explode(F.array(
        F.lit("COPY public.games (" + ", ".join(g.columns) + ") FROM stdin;"), F.lit(io.COPY_END))).alias("value"))
    path = scratch_path(spark, "copy-block")
    lines.unionAll(frame).write.text(path)
    good = io.read_copy_text(spark, path, g.schema).select("game_id", F.lit(None).cast("string").alias("reason"))
    bad = io.read_copy_quarantine(spark, path, g.schema).select(
        F.substring_index("line", "\t", 1).cast("bigint").alias("game_id"), "reason")
    return good.unionAll(bad)


@query("a3_shape_a")
def q_shape_a(spark, d):
    """Catalogue documents with answers as texts and the right one's index: written, read with the
    declared schema, turned into answer rows."""
    a = nested.nest_in_pages(sv.answers(spark, d), ["question_id"], ["answer_id"],
                             F.struct(F.col("text"), F.col("right_wrong")), 1000, "answers")
    texts, correct = nested.to_indexed_form(F.col("answers"))
    docs = a.select(F.col("question_id").alias("id"), F.concat(F.lit("Frage "), F.col("question_id").cast("string")).alias("question"),
                    texts.alias("answers"), correct.alias("correct"))
    path = scratch_path(spark, "shape-a")
    io.write_json_snapshot(docs, path)
    return nested.catalogue_from_shape_a(io.read_catalogue_json(spark, path, nested.QUESTION_A))


@query("a4_with_fallback")
def q_fallback(spark, d):
    u = sv.users(spark, d).select("user_id", "username")
    primary = u.filter(F.col("user_id") % 3 == 0).withColumn("username", F.upper("username")) \
        .withColumn("source", F.lit("registered"))
    fallback = u.withColumn("source", F.lit("stored"))
    return io.with_fallback(primary, fallback, ["user_id"])


@query("a5_parse_json_props")
def q_parse_json(spark, d):
    e = sv.table(spark, d, "events").select("event_id", "props")
    return io.parse_json_column(e, "props", "k INT").select("event_id", F.col("parsed.k").alias("k"))


@query("a7_layout_pruned_read")
def q_layout(spark, d):
    path = scratch_path(spark, "questions-layout")
    io.write_layout(sv.questions(spark, d), path, ["status"], ["course_id", "question_id"])
    back = spark.read.parquet(path)
    return back.filter((F.col("status") == "approved") & (F.col("course_id") == 2)).select(
        "question_id", "course_id", "status", F.char_length("text").alias("n_chars"))


@query("a7_layout_rewrite")
def q_layout_rewrite(spark, d):
    """The whole table back after a second overwrite without the approved questions: nothing of the
    first write remains."""
    path = scratch_path(spark, "questions-rewrite")
    q = sv.questions(spark, d)
    io.write_layout(q, path, ["status"], ["course_id", "question_id"])
    io.write_layout(q.filter(F.col("status") != "approved"), path, ["status"], ["course_id", "question_id"])
    return spark.read.parquet(path).select("question_id", "course_id", "status", "text")


@query("a8_read_events_stream")
def q_read_events_stream(spark, d):
    out = scratch_path(spark, "a8-events")
    e = io.read_events(spark, feed(spark, d, "events", "ts")[0], streaming=True, max_files_per_trigger=FEED_FILES // FEED_BATCHES)
    streams.run_available_now(e.writeStream.format("parquet").outputMode("append"), "a8", spark, out)
    return spark.read.parquet(out).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type")


@query("a8_read_events")
def q_read_events(spark, d):
    return io.read_events(spark, f"{d.rstrip('/')}/events.parquet").select("event_id", "ts", "user_id", "event_type")


TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
               "benchmark labels conversations").split()


@query("e5_table_profile")
def q_table_profile(spark, d):
    p = io.table_profile(spark, {t: f"{d.rstrip('/')}/{t}.parquet" for t in TABLE_NAMES})
    return p.select("table_name", "row_count")


@query("g2_tables_by_size")
def q_tables_by_size(spark, d):
    """The profile's order: by rank, no table is larger than the one before it."""
    p = io.table_profile(spark, {t: f"{d.rstrip('/')}/{t}.parquet" for t in TABLE_NAMES})
    before = F.lag("data_bytes").over(Window.orderBy("size_rank"))  # fourteen rows
    return p.select("table_name", "row_count", (F.col("data_bytes") > 0).alias("has_bytes"), F.coalesce(before >= F.col("data_bytes"), F.col("size_rank") == 1).alias("in_order"),
                    F.col("table_size").rlike("^[0-9]+ (bytes|kB|MB|GB|TB|PB)$").alias("readable"))


@query("a7_bucketed_results")
def q_bucketed_results(spark, d):
    """E2 over answers and games that are bucketed by game: no shuffle of the answers."""
    tag = scratch_path(spark, "a7").rsplit("-", 1)[-1]
    ga = io.write_bucketed(sv.game_answers(spark, d), f"game_answers_{tag}", scratch_path(spark, "a7-answers"), ["game_id"], 16)
    g = io.write_bucketed(sv.games(spark, d), f"games_{tag}", scratch_path(spark, "a7-games"), ["game_id"], 16)
    return reports.quiz_results(sv.users(spark, d), ga, g, sv.courses(spark, d))


@query("b_table_audit")
def q_table_audit(spark, d):
    """The declared constraints of all twelve tables, counted."""
    return audit.audit(audit_tables(spark, d))


def audit_tables(spark, d):
    """The twelve tables over the stand-ins, with admins 0 to 5 and the change log of the orders."""
    q, u = sv.questions(spark, d), sv.users(spark, d)
    admins = sv.table(spark, d, "supplier").filter("s_suppkey < 6").select(F.col("s_suppkey").alias("admin_id"), F.col("s_name").alias("username"))
    answers = sv.game_answers(spark, d).withColumn("game_answer_id", F.col("game_id") * 10 + F.col("round_no"))
    old = sv.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    log = changes.audit_diff(old.filter("o_orderkey % 3 > 0"), old, ["o_orderkey"], "orders", NOW).withColumn("log_id", F.col("o_orderkey") % 100)
    games = sv.games(spark, d).withColumn("status", F.when(F.col("game_id") % 50 == 0, "bogus").otherwise(F.col("status")))
    return {"avatars": sv.avatars(spark, d), "users": u, "admins": admins, "courses": sv.courses(spark, d), "questions": q, "answers": sv.answers(spark, d),
            "game_groups": sv.game_groups(spark, d), "games": games, "game_rounds": sv.game_rounds(spark, d), "game_answers": answers,
            "chats": sv.chats(spark, d).withColumn("user_id", F.col("game_id")), "audit_log": log}


# ---------------------------------------------------------------- K streaming twins (availableNow runs)
from quizmart.streaming import carried, keyed, streams  # noqa: E402


PART_BYTES = 16 << 20
FEED_BATCHES, FEED_FILES = 3, 12


def feed(spark, d, name, order_col, heartbeat=None):
    """A table as a feed: files in the order of ``order_col`` (then of the first columns, its keys, so
    that a hot value is spread over files), written by one range-partitioned job. A stream takes files by time,
    so they get times in their order. ``heartbeat``, one row, becomes the last file. Returns the folder and
    the number of files."""
    t = sv.table(spark, d, name)
    n = max(FEED_FILES, input_partitions(t, PART_BYTES))
    order = [F.col(order_col).asc_nulls_first(), *[F.col(c) for c in t.columns[:3] if c != order_col]]
    root = scratch_path(spark, f"feed-{name}")
    t.repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    if heartbeat is not None:
        heartbeat.coalesce(1).write.mode("append").parquet(root)
        files += [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-") and f.getPath().getName() not in {x.getName() for x in files}]
    for k, f in enumerate(files):
        fs.setTimes(f, 1_700_000_000_000 + 1000 * k, -1)
    return root, len(files)


def feed_stream(spark, d, name, order_col, heartbeat=None):
    """The feed as a stream of ``FEED_BATCHES`` micro-batches, however many files it has."""
    root, n = feed(spark, d, name, order_col, heartbeat)
    r = spark.readStream.schema(sv.table(spark, d, name).schema).option("maxFilesPerTrigger", max(1, -(-n // FEED_BATCHES)))
    return r.parquet(root)


def answer_stream(spark, d):
    return sv.game_answers_from(feed_stream(spark, d, "lineitem", "l_shipdate"), sv.table(spark, d, "orders"))


def event_stream(spark, d, heartbeat=None):
    raw = feed_stream(spark, d, "events", "ts", heartbeat)
    e = sv.events_from(raw, "props").withColumnRenamed("props", "text")
    return (e.withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("lobby", F.date_format("ts", "yyyy-MM-dd")))


@query("k1_stream_answers")
def q_stream_answers(spark, d):
    sink, quarantine = scratch_path(spark, "k1-sink"), scratch_path(spark, "k1-quarantine")
    w = streams.stream_answers(with_unknown(answer_stream(spark, d)), sv.answers(spark, d), sink, quarantine,
                               order=TIE_ORDER)
    streams.run_available_now(w, "k1", spark)
    kept = spark.read.parquet(sink).select(*ANSWER_COLS, F.lit(None).cast("string").alias("reason"))
    # which of the two reasons a duplicate gets depends on the micro-batches, so both read "duplicate"
    return kept.unionByName(spark.read.parquet(quarantine).select(
        *ANSWER_COLS, F.regexp_replace("reason", "duplicate_.*", "duplicate").alias("reason")))


@query("k1_first_answers")
def q_first_answers(spark, d):
    """The first answers by arrival with the keys in the state store, and how often a key has come."""
    sink = scratch_path(spark, "k1-first")
    first = keyed.stream_first_answers(with_unknown(answer_stream(spark, d)), sv.answers(spark, d), order=TIE_ORDER)
    streams.run_available_now(keyed.write_first_answers(first, sink), "k1first", spark)
    seen = spark.read.parquet(sink)
    n = seen.groupBy("game_id", "user_id", "round_no").agg(F.max("n").alias("answers_seen"))
    return seen.filter("accepted = 'true'").join(n, ["game_id", "user_id", "round_no"]).select(*ANSWER_COLS, "answers_seen")


@query("k2_stream_scores")
def q_stream_scores(spark, d):
    out = scratch_path(spark, "k2-scores")
    agg = streams.stream_scores(answer_stream(spark, d), sv.games(spark, d))
    streams.run_available_now(streams.write_updates(agg, out), "k2", spark)
    return streams.latest_values(out, spark, ["user_id"])


@query("k3_stream_lobby")
def q_stream_lobby(spark, d):
    out = scratch_path(spark, "k3-pairs")
    pairs = streams.stream_lobby(event_stream(spark, d))
    streams.run_available_now(pairs.writeStream.format("parquet").outputMode("append"), "k3", spark, out)
    return spark.read.parquet(out).withColumn("paired_at", F.col("paired_at").cast("timestamp_ntz"))


@query("k3_hot_lobby")
def q_stream_hot_lobby(spark, d):
    """All events in one lobby, paired by the distributed fold of each micro-batch."""
    out = scratch_path(spark, "k3-hot")
    e = event_stream(spark, d).withColumn("lobby", F.lit("all"))
    streams.run_available_now(carried.stream_lobby_pairs(e, out, scratch_path(spark, "k3-hot-state")), "k3hot", spark)
    p = spark.read.parquet(out).withColumn("paired_at", F.col("paired_at").cast("timestamp_ntz"))
    return p.select("lobby", "group_no", "player1", "player2", "paired_at", "event_id")


def connections(spark, d):
    out = scratch_path(spark, "k4-connections")
    e = event_stream(spark, d).drop("text", "lobby")
    streams.run_available_now(carried.stream_connections(e, out, scratch_path(spark, "k4-open"), connect=OPENS), "k4c", spark)
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("k4_stream_gauge")
def q_stream_gauge(spark, d):
    """Connected sockets after each event, over the stream."""
    return connections(spark, d).select("event_id", "ts", "user_id", "kind", "connected")


@query("k5_stream_recipients")
def q_stream_recipients(spark, d):
    """Recipients of each chat message, over the stream."""
    return connections(spark, d).filter(F.col("kind") == "chat-message").select(
        "event_id", "ts", F.col("user_id").alias("sender"), "connected", "recipients")


@query("k4_stream_presence")
def q_stream_presence(spark, d):
    out = scratch_path(spark, "k4-presence")
    p = streams.stream_presence(event_stream(spark, d), connect=OPENS, join="page")
    streams.run_available_now(p.writeStream.format("parquet").outputMode("append"), "k4", spark, out)
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("k5_stream_chat")
def q_stream_chat(spark, d):
    out = scratch_path(spark, "k5-chat")
    c = streams.stream_chat(event_stream(spark, d), sv.users(spark, d))
    streams.run_available_now(c.writeStream.format("parquet").outputMode("append"), "k5", spark, out)
    return spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("k6_stream_join_timeouts")
def q_stream_timeouts(spark, d):
    """The stream's timeouts and, at the end of the input, those of the requests still pending."""
    out = scratch_path(spark, "k6-timeouts")
    e = event_stream(spark, d).drop("text")
    t = streams.stream_join_timeouts(e.filter(F.col("kind") == "requestJoin"), e.filter(F.col("kind") == "answer"),
                                     "2 hours", "3 hours")
    q = streams.run_available_now(t.writeStream.format("parquet").outputMode("append"), "k6", spark, out)
    emitted = spark.read.schema(t.schema).parquet(out)
    whole = sv.events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    rest = streams.flush_join_timeouts(whole.filter(F.col("kind") == "requestJoin"), whole.filter(F.col("kind") == "answer"),
                                       emitted, "2 hours", streams.last_watermark(q))
    return emitted.unionByName(rest).withColumn("request_ts", F.col("request_ts").cast("timestamp_ntz"))


@query("k6_timer_timeouts")
def q_timer_timeouts(spark, d):
    """As k6_stream_join_timeouts by event-time timers; the feed ends with a heartbeat, so the stream
    alone gives every timeout."""
    out, events = scratch_path(spark, "k6-timers"), sv.table(spark, d, "events")
    beat = events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(
        *[F.col("ts") if c == "ts" else F.lit(None).cast(kind).alias(c) for c, kind in events.dtypes])
    e = event_stream(spark, d, beat)
    t = keyed.stream_timeouts(e, F.coalesce(F.col("kind") == "requestJoin", F.lit(False)), F.coalesce(F.col("kind") == "answer", F.lit(False)), 7200, "3 hours")
    streams.run_available_now(t.writeStream.format("parquet").outputMode("append"), "k6timers", spark, out)
    return spark.read.schema(t.schema).parquet(out).withColumn("request_ts", F.col("request_ts").cast("timestamp_ntz"))


@query("k7_stored_audit")
def q_stored_audit(spark, d):
    """As k7_stream_audit, against a bucketed stored table."""
    root, log = scratch_path(spark, "k7-stored"), scratch_path(spark, "k7-log")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    stored.create(sv.table(spark, d, "orders").select(*cols), root, ["o_orderkey"], 32)
    streams.run_available_now(carried.stream_audit_stored(order_versions(spark, d), root, log, "orders", NOW, op_col="op"), "k7s", spark)
    return audit_columns(spark.read.parquet(log))


@query("k7_stream_audit")
def q_stream_audit(spark, d):
    """Row versions of the orders: shifted keys are new, some keys are deleted, the others updated."""
    target, audit = scratch_path(spark, "k7-target"), scratch_path(spark, "k7-audit")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    sv.table(spark, d, "orders").select(*cols).write.mode("overwrite").parquet(f"{target}/batch_id=-1")
    streams.run_available_now(streams.stream_audit(order_versions(spark, d), target, audit, ["o_orderkey"], "orders", NOW, op_col="op"), "k7", spark)
    return audit_columns(spark.read.parquet(audit))


def order_versions(spark, d):
    k = F.col("o_orderkey")
    return feed_stream(spark, d, "orders", "o_orderkey").select(
        F.when(k % 10 == 0, k + NEW_KEYS).otherwise(k).alias("o_orderkey"), "o_custkey", "o_orderstatus",
        F.when(k % 10 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate",
        F.when(k % 10 == 1, "DELETE").otherwise("UPSERT").alias("op"))


def audit_columns(a):
    return a.select("o_orderkey", "table_name", "operation", "user_id", "timestamp",
                    F.get_json_object("old_values", "$.o_totalprice").cast("double").alias("old_totalprice"),
                    F.get_json_object("new_values", "$.o_totalprice").cast("double").alias("new_totalprice"),
                    F.get_json_object("new_values", "$.o_orderstatus").alias("new_orderstatus"))


# ---------------------------------------------------------------- C18, F1 (standalone forms)
from quizmart.functions import scalars  # noqa: E402


@query("c18_size_pretty")
def q_size_pretty(spark, d):
    o = sv.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    b = F.floor(F.col("o_totalprice") * F.pow(F.lit(4), F.col("o_orderkey") % 12)).cast("bigint")
    return o.select("o_orderkey", b.alias("bytes"), scalars.size_pretty(b).alias("size"))


@query("f1_question_pager")
def q_pager(spark, d):
    return screens.question_pager(sv.questions(spark, d).select("question_id", "course_id")).select(
        "question_id", "course_id", "position", "question_total", "pager_label", "has_prev", "has_next")
