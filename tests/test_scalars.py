"""Column scalars (C1-C19) on edge rows: NULLs, %/_ in search terms, upper case, umlauts."""
from pyspark.sql import functions as F

from quizmart.functions import scalars as S


def _one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr.alias("x")).collect()]


def test_search(spark):
    data = [("Quiz 100%", "Ärger", None), ("a_b", None, ["Größe", None]), ("x", "y", [])]
    schema = "title string, author string, tags array<string>"
    assert _one(spark, S.search_match(["title", "author"], " 100% "), data, schema) == [True, False, False]
    assert _one(spark, S.search_match(["title", "author"], "_"), data, schema) == [False, True, False]
    assert _one(spark, S.search_match(["title", "author"], "ärger"), data, schema) == [True, False, False]
    assert _one(spark, S.search_match(["title"], "  "), data, schema) == [True, True, True]
    assert _one(spark, S.search_match(["title", "author"], "b  größe", ["tags"]), data, schema) == [False, True, False]
    # a missing field keeps its separator: "x" + " " + "" + " " + "" for the 3rd row
    assert _one(spark, S.search_text(["title", "author"], ["tags"]), data, schema)[2] == "x y "


def test_labels_actions_escape(spark):
    data = [("approved",), ("rejected",), ("pending",), (None,), ("bogus",)]
    assert _one(spark, S.status_label("s"), data, "s string") == [
        "Angenommen", "Abgelehnt", "Ausstehend", "Ausstehend", "Ausstehend"]
    a, r = S.moderation_actions("s")
    assert _one(spark, a, data, "s string") == [False, True, True, True, True]
    assert _one(spark, r, data, "s string") == [True, False, True, True, True]
    esc = [("<a href=\"x\">Tom & Jerry's</a>",), (None,), ("",)]
    assert _one(spark, S.escape_html("s"), esc, "s string") == [
        "&lt;a href=&quot;x&quot;&gt;Tom &amp; Jerry&#039;s&lt;/a&gt;", "", ""]
    assert _one(spark, S.escape_html("s", null_as="null"), esc, "s string")[1] == "null"


def test_dates_numbers_urls(spark):
    assert _one(spark, S.format_date_de("s"), [("2024-03-05T10:00:00Z",), ("nope",), (None,)], "s string") == [
        "05.03.2024", "nope", None]
    assert _one(spark, S.parse_int_or_zero("s"), [("  42px",), ("-7",), ("x1",), (None,), ("+3",)], "s string") == [
        42, -7, 0, 0, 3]
    assert _one(spark, S.answer_label("p"), [(0,), (1,), (3,)], "p int") == ["A", "B", "D"]
    assert _one(spark, S.avatar_id_for_file("f"), [("avatar2.jpeg",), ("avatar3.jpeg",), ("x",), (None,)],
                "f string") == [32, 33, 31, 31]
    assert _one(spark, S.avatar_file_from_url("u"), [("https://h/img/my%20cat.png?x=1",), ("https://h/",), (None,)],
                "u string") == ["my cat.png", "avatar1.jpeg", "avatar1.jpeg"]
    assert _one(spark, S.player_name("s"), [("abcdefg",), ("ab",)], "s string") == ["Spielerabcd", "Spielerab"]
    assert _one(spark, S.size_pretty("b"), [(10239,), (10240,), (5 * 1024 ** 3,), (20 * 1024 ** 3,)], "b long") == [
        "10239 bytes", "10 kB", "5120 MB", "20 GB"]


def test_feedback_and_forms(spark):
    d = [(True, "4"), (False, " Berlin "), (False, None), (False, "")]
    assert _one(spark, S.answer_feedback(F.col("r"), F.col("t")), d, "r boolean, t string") == [
        S.FEEDBACK_RIGHT, "ℹ️ Hinweis: Die richtige Antwort ist Berlin.", S.FEEDBACK_WRONG_GENERIC,
        S.FEEDBACK_WRONG_GENERIC]
    reg = [("A", "B", "usr", "e@x", "12345"), ("A", " ", "usr", "e@x", "12345"), ("A", "B", "usr", "e@x", "1234"),
           ("A", "B", "us", "e@x", "12345")]
    assert _one(spark, S.registration_rule("f", "s", "u", "e", "p"), reg,
                "f string, s string, u string, e string, p string") == [
        None, S.MSG_FILL_ALL, S.MSG_PASSWORD_5, S.MSG_USERNAME_3]
    prof = [("", None, "abc"), ("short", "short", "abc"), ("longenough", "other", "abc"), ("longenough", "longenough", "ab")]
    assert _one(spark, S.profile_rule("p", "c", "u"), prof, "p string, c string, u string") == [
        None, S.MSG_PROFILE_PASSWORD_8, S.MSG_PROFILE_MISMATCH, S.MSG_PROFILE_USERNAME_3]
    sub = [("Q", ["a", "b", "c", "d"], 1, "Mathe"), ("Q", ["a", " ", "c", "d"], 1, "Mathe"), ("Q", ["a", "b", "c", "d"], None, "M")]
    assert _one(spark, S.submission_rule("t", "a", "c", "g"), sub, "t string, a array<string>, c int, g string") == [
        None, S.MSG_SUBMISSION, S.MSG_SUBMISSION]
    marked = _one(spark, S.submission_answers("a", "c"), sub[:1], "t string, a array<string>, c int, g string")[0]
    assert [(m["text"], m["right_wrong"]) for m in marked] == [("a", False), ("b", True), ("c", False), ("d", False)]


def test_survey_named_screen_functions(spark):
    from quizmart.operators import screens
    df = spark.createDataFrame([(1, "Mathe 100%"), (2, "Geo")], "id long, title string")
    assert [r.id for r in screens.search(df, ["title"], " 100% ").collect()] == [1]
    forms = spark.createDataFrame([("A", "B", "usr", "e@x", "12345", "avatar2.jpeg"), ("A", "B", "u", "e@x", "12345", None)],
                                  "firstname string, surname string, username string, email string, password string, "
                                  "avatar_file string")
    v = screens.violations_registration(forms).collect()
    assert len(v) == 1 and v[0].rule == S.MSG_USERNAME_3


def test_size_pretty_unit_limits(spark):
    """Fixed value table at the limits of every unit."""
    table = [(0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (10485247, "10239 kB"), (10485248, "10 MB"),
             (10736893951, "10239 MB"), (10736893952, "10 GB"), (10994579406847, "10239 GB"), (10994579406848, "10 TB"),
             (11258449312612351, "10239 TB"), (11258449312612352, "10 PB"), (9000000000000000000, "7994 PB"),
             (-10239, "-10239 bytes"), (-10240, "-10 kB"), (-10485248, "-10 MB"), (None, None)]
    df = spark.createDataFrame([(b,) for b, _ in table], "b long")
    got = {r.b: r.s for r in df.select("b", S.size_pretty("b").alias("s")).collect()}
    assert got == dict(table)


def test_submission_rule_needs_four_answers_and_a_valid_index(spark):
    four = ["a", "b", "c", "d"]
    data = [(1, four, 0), (2, four, 4), (3, four, -1), (4, four[:1], 0), (5, None, 0), (6, [*four[:3], None], 0), (7, four, None), (8, [*four, "e"], 0)]
    df = spark.createDataFrame(data, "id long, answers array<string>, correct int")
    got = {r.id: r.r for r in df.select("id", S.submission_rule(F.lit("t"), "answers", "correct", F.lit("c")).alias("r")).collect()}
    assert {k for k, v in got.items() if v is None} == {1}
