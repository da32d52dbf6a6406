"""

``moderation_board`` (C1-C8), ``catalogue_view`` (C1, C7, F1), ``feedback_report`` (C13),
``registration_check``/``profile_check``/``submission_screen`` (C15-C17), ``profile_load``
(C9-C11, C14). All are projections/filters/joins over whole tables.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmart.functions import scalars as S
from quizmart.operators.scan import running_sum


def moderation_board(items: DataFrame, term: str | None, status: str | None, search_cols: Iterable[str],
                     array_cols: Iterable[str] = (), id_col: str = "id", title_col: str = "title",
                     created_col: str | None = None, null_as: str = "null") -> DataFrame:
    """Admin moderation list: search (C1/C2) + status filter (C3), label (C4), German date (C5),
    escaped title (C6), allowed actions (C8)."""
    sel = items.filter(S.search_match(list(search_cols), term, list(array_cols))
                       & S.filter_status("status", status))
    can_approve, can_reject = S.moderation_actions("status")
    cols = [F.col(id_col), S.escape_html(title_col, null_as=null_as).alias("title_html"),
            F.col("status"), S.status_label("status").alias("status_label"),
            can_approve.alias("can_approve"), can_reject.alias("can_reject")]
    if created_col:
        cols.append(S.format_date_de(created_col).alias("created_de"))
    return sel.select(*cols)


def catalogue_view(courses: DataFrame, questions: DataFrame, answers: DataFrame, term: str | None) -> DataFrame:
    """Catalogue page: courses matching ``term`` (C1 on the course name), their questions with the
    pager ("Frage i von n", has_prev/has_next — F1) and each answer with its letter (C7).

    Question position per course comes from the skew-proof scan: a course holding a large share
    of all questions is still spread over many tasks.
    """
    c = courses.filter(S.search_match(["course_name"], term)).select("course_id", "course_name")
    q = questions.select("question_id", "course_id", "text").join(c, "course_id")
    q = question_pager(q)
    a = answers.select("answer_id", "question_id", F.col("text").alias("answer_text"), "right_wrong")
    a = running_sum(a, ["question_id"], ["answer_id"], F.lit(1), "answer_pos")
    a = a.withColumn("answer_label", S.answer_label(F.col("answer_pos") - 1)).drop("answer_pos")
    return q.join(a, "question_id", "left")


def question_pager(questions: DataFrame, key: str = "course_id", order: str = "question_id") -> DataFrame:
    """per course, position i (1-based), count n, label "Frage i von n", has_prev, has_next."""
    pos = running_sum(questions, [key], [order], F.lit(1), "position")
    n = questions.groupBy(key).agg(F.count(F.lit(1)).alias("question_total"))
    out = pos.join(n, key)
    return (out.withColumn("pager_label", F.concat(F.lit("Frage "), F.col("position").cast("string"),
                                                   F.lit(" von "), F.col("question_total").cast("string")))
            .withColumn("has_prev", F.col("position") > 1)
            .withColumn("has_next", F.col("position") < F.col("question_total")))


def feedback_report(given: DataFrame, answers: DataFrame) -> DataFrame:
    """Feedback for each given answer. The right answer shown is the first right answer of
    the question (lowest answer_id, the first button on the page)."""
    truth = answers.select("answer_id", F.col("question_id").alias("q_of_answer"),
                           F.col("right_wrong").alias("is_right"))
    rights = (answers.filter(F.col("right_wrong"))
              .groupBy("question_id").agg(F.min_by("text", "answer_id").alias("right_text")))
    g = given.join(truth, "answer_id", "left")
    g = g.join(rights, g.q_of_answer == rights.question_id, "left").drop(rights.question_id)
    return g.withColumn("feedback", S.answer_feedback(F.coalesce("is_right", F.lit(False)), "right_text"))


def registration_check(forms: DataFrame) -> DataFrame:
    """C15 (+C9): first failing registration rule per form, NULL if accepted; avatar id."""
    return forms.withColumn("rule", S.registration_rule("firstname", "surname", "username", "email", "password")) \
        .withColumn("avatar_id", S.avatar_id_for_file("avatar_file"))


def profile_check(forms: DataFrame) -> DataFrame:
    """First failing profile rule per form, NULL if accepted."""
    return forms.withColumn("rule", S.profile_rule("password", "confirm_password", "username"))


def submission_screen(subs: DataFrame) -> DataFrame:
    """C17: question-form check; accepted rows get status 'pending' and answers marked right/wrong."""
    rule = S.submission_rule("text", "answers", "correct", "category")
    out = subs.withColumn("rule", rule)
    return (out.withColumn("status", F.when(F.col("rule").isNull(), F.lit("pending")))
            .withColumn("marked", F.when(F.col("rule").isNull(), S.submission_answers("answers", "correct"))))


def profile_load(pages: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """C9-C11, C14 over URLs: avatar file from the URL (C10), its avatar id (C9), the player name
    of the id (C11) and the integer prefix of the last path segment (C14)."""
    f = S.avatar_file_from_url(url_col)
    seg = F.element_at(F.split(F.col(url_col), "/"), -1)
    return pages.select(F.col(id_col), f.alias("avatar_file"), S.avatar_id_for_file(f).alias("avatar_id"),
                        S.player_name(F.col(id_col)).alias("player_name"),
                        S.parse_int_or_zero(seg).alias("page_no"))


def search(df: DataFrame, cols: Iterable[str], term: str | None, array_cols: Iterable[str] = ()) -> DataFrame:
    """Rows whose fields (and array elements) contain the trimmed, lower-cased term."""
    return df.filter(S.search_match(list(cols), term, list(array_cols)))


def violations_registration(forms: DataFrame) -> DataFrame:
    """Registration forms that fail, with the first failing rule in ``rule``."""
    return registration_check(forms).filter(F.col("rule").isNotNull())


def violations_profile(forms: DataFrame) -> DataFrame:
    """Profile forms that fail, with the first failing rule in ``rule``."""
    return profile_check(forms).filter(F.col("rule").isNotNull())


def violations_question_submission(subs: DataFrame) -> DataFrame:
    """C17: question submissions that fail the form check."""
    return submission_screen(subs).filter(F.col("rule").isNotNull())
