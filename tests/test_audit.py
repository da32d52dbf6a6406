"""Table audit, statement abort, bucketed layout, and the report oracles on odd dimensions."""
import datetime as dt
import glob
import os
import re

import duckdb
import pytest

from conftest import rows
from quizmart.operators import audit, changes, reports
from quizmart.plans.oracle import ORACLE
from quizmart.session import scratch_path
from quizmart.sources import io

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "courses": spark.createDataFrame([(1, "a"), (2, "x" * 101), (2, None), (None, "n")], "course_id int, course_name string"),
        "games": spark.createDataFrame([(1, 1, 5, "waiting"), (2, 9, None, "bogus"), (2, None, 6, None), (3, 2, 5, "y" * 21)],
                                       "game_id int, course_id int, user_id int, status string"),
        "users": spark.createDataFrame([(5, "u"), (5, "u"), (7, None)], "user_id int, username string"),
    }


def test_every_rule_is_counted(tables):
    got = {(r.table_name, r.rule): r.violations for r in audit.audit(tables).collect()}
    assert got == {
        ("courses", "not_null(course_id)"): 1, ("courses", "not_null(course_name)"): 1, ("courses", "unique(course_id)"): 2, ("courses", "length(course_name)>100"): 1,
        ("games", "not_null(game_id)"): 0, ("games", "unique(game_id)"): 2, ("games", "fk(course_id->courses.course_id)"): 1, ("games", "fk(user_id->users.user_id)"): 1,
        ("games", "domain(status)"): 2, ("games", "length(status)>20"): 1,
        ("users", "not_null(user_id)"): 0, ("users", "not_null(firstname)"): 3, ("users", "not_null(surname)"): 3, ("users", "not_null(username)"): 1, ("users", "not_null(email)"): 3,
        ("users", "not_null(password)"): 3, ("users", "unique(user_id)"): 2, ("users", "unique(username)"): 2, ("users", "length(username)>30"): 0}


def test_audited_rows_are_written_once_with_their_counts(spark, tables):
    path = scratch_path(spark, "audited")
    counts = audit.store_audited(tables, "games", path)
    assert counts["domain(status)"] == 2 and counts["fk(user_id->users.user_id)"] == 1
    out = spark.read.parquet(path)
    assert rows(out.filter("ok = 'true'"), "game_id", "status") == [(1, "waiting")]
    assert out.count() == 4 and out.filter("ok = 'false'").selectExpr("explode(broken)").count() == sum(counts.values())


def committed(path):
    return glob.glob(os.path.join(path.removeprefix("file:"), "**", "*.parquet"), recursive=True) + glob.glob(os.path.join(path.removeprefix("file:"), "_SUCCESS"))


def test_an_aborted_statement_commits_nothing(spark, tables):
    path = scratch_path(spark, "abort")
    with pytest.raises(Exception, match="constraint violated: domain"):
        audit.store_audited({**tables, "games": tables["games"].filter("status = 'bogus'")}, "games", path, mode="abort")
    assert committed(path) == []
    good = {**tables, "games": tables["games"].filter("game_id = 1")}
    assert sum(audit.store_audited(good, "games", path, mode="abort").values()) == 0 and committed(path)


def test_abort_inside_an_ingest(spark):
    answers = spark.createDataFrame([(1, 1, True)], "answer_id int, question_id int, right_wrong boolean")
    schema = "game_id int, user_id int, answer_id int, round_no int, right_wrong boolean, answered_at timestamp_ntz"
    stored = spark.createDataFrame([], schema)
    good, bad = spark.createDataFrame([(1, 1, 1, 1, False, T0)], schema), spark.createDataFrame([(1, 1, 1, 2, False, T0), (1, 2, 9, 1, True, T0)], schema)
    path = scratch_path(spark, "ingest")
    changes.or_abort(changes.ingest_decisions(stored, good, answers), good.columns).write.parquet(path)
    assert rows(spark.read.parquet(path), "user_id", "right_wrong") == [(1, True)]
    other = scratch_path(spark, "ingest")
    with pytest.raises(Exception, match="change rejected: unknown_answer"):
        changes.or_abort(changes.ingest_decisions(stored, bad, answers), bad.columns).write.parquet(other)
    assert committed(other) == []


def exchanges(plan):
    return re.findall(r"^[ :+\-|]*\(?\d*\)? ?(?:Exchange|ShuffleQueryStage)[^\n]*", plan, re.M)


def test_bucketed_results_do_not_shuffle_the_answers(spark):
    n = 200
    answers = spark.range(n).selectExpr("id % 40 AS game_id", "id % 7 AS user_id", "id % 3 = 0 AS right_wrong")
    games = spark.range(40).selectExpr("id AS game_id", "CAST(id % 4 AS INT) AS course_id")
    users = spark.range(7).selectExpr("id AS user_id", "concat('u', id) AS username")
    courses = spark.range(4).selectExpr("CAST(id AS INT) AS course_id", "concat('c', id) AS course_name")
    tag = os.urandom(4).hex()
    ga = io.write_bucketed(answers, f"ga_{tag}", scratch_path(spark, "ga"), ["game_id"], 8)
    g = io.write_bucketed(games, f"g_{tag}", scratch_path(spark, "g"), ["game_id"], 8)
    try:
        got = reports.quiz_results(users, ga, g, courses)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan or "SelectedBucketsCount: 8 out of 8" in plan
        shuffles = [x for x in plan.splitlines() if re.search(r"Exchange hashpartitioning", x)]
        assert not any("right_wrong" in x or "game_id" in x for x in shuffles), plan
        cols = ("username", "game_id", "course_name", "total_answers", "correct_answers")
        assert rows(got, *cols) == rows(reports.quiz_results(users, answers, games, courses), *cols)
        files = [r[0] for r in ga.selectExpr("input_file_name()").distinct().collect()]
        assert len(files) > 8  # a bucket is written by several tasks
    finally:
        spark.sql(f"DROP TABLE ga_{tag}")
        spark.sql(f"DROP TABLE g_{tag}")


def test_profile_orders_by_size(spark):
    paths = {}
    for name, n in (("small", 1), ("large", 5000), ("none", 0)):
        paths[name] = scratch_path(spark, name)
        spark.range(n).coalesce(1).write.parquet(paths[name])
    want = {name: sum(os.path.getsize(f) for f in glob.glob(p.removeprefix("file:") + "/*.parquet")) for name, p in paths.items()}
    got = io.table_profile(spark, paths).collect()
    assert [(r.table_name, r.data_bytes, r.size_rank) for r in got] == [(n, b, i) for i, (n, b) in enumerate(sorted(want.items(), key=lambda x: -x[1]), 1)]
    assert {r.table_name: r.row_count for r in got} == {"small": 1, "large": 5000, "none": 0}


def test_report_oracles_on_repeated_and_missing_dimension_keys(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT * FROM (VALUES (1, 'a', 3, 's'), (1, 'a2', 3, 's'), (2, 'b', 9, 's'), (4, NULL, NULL, 's')) t(c_custkey, c_name, c_nationkey, c_mktsegment)")
    con.execute("CREATE TABLE nation AS SELECT * FROM (VALUES (3, 'N'), (3, 'M'), (7, 'X')) t(n_nationkey, n_name)")
    con.execute("CREATE TABLE region AS SELECT * FROM (VALUES (0, 'r'), (0, 'q'), (1, 'r')) t(r_regionkey, r_name)")
    con.execute("""CREATE TABLE orders AS SELECT o_orderkey, o_custkey, o_orderpriority, 'O' AS o_orderstatus, TIMESTAMP '2024-01-01' AS o_orderdate
                   FROM (VALUES (10, 1, '1-x'), (11, 2, '2-x'), (12, 9, '1-x'), (13, 1, '5-x')) t(o_orderkey, o_custkey, o_orderpriority)""")
    con.execute("""CREATE TABLE lineitem AS SELECT *, 1 AS l_partkey, 1 AS l_linenumber, TIMESTAMP '2024-01-01' AS l_shipdate, 1 AS l_suppkey, 1.0 AS l_extendedprice, 1.0 AS l_quantity
                   FROM (VALUES (10, 'R'), (10, 'R'), (10, 'A'), (11, NULL), (12, 'R'), (13, 'R'), (99, 'R')) t(l_orderkey, l_returnflag)""")
    q = {t: spark.createDataFrame(con.execute(sql).fetchdf().astype(object).where(lambda f: f.notna(), None), schema) for t, sql, schema in (
        ("users", "SELECT c_custkey AS user_id, c_name AS username, c_nationkey AS avatar_id FROM customer", "user_id long, username string, avatar_id long"),
        ("avatars", "SELECT n_nationkey AS avatar_id, n_name AS avatar_name FROM nation", "avatar_id long, avatar_name string"),
        ("courses", "SELECT r_regionkey AS course_id, r_name AS course_name FROM region", "course_id long, course_name string"),
        ("games", "SELECT o_orderkey AS game_id, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS course_id FROM orders", "game_id long, course_id long"),
        ("answers", "SELECT l_orderkey AS game_id, o_custkey AS user_id, l_returnflag = 'R' AS right_wrong FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "game_id long, user_id long, right_wrong boolean"))}
    cols = ("username", "game_id", "course_name", "total_answers", "correct_answers")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE['e2_quiz_results']})").fetchall()
    got = rows(reports.quiz_results(q["users"], q["answers"], q["games"], q["courses"]), *cols)
    assert got == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t)) and len(got) == 5
    cols = ("user_id", "username", "avatar_id", "avatar_name")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE['d1_users_with_avatars']})").fetchall()
    assert rows(reports.users_with_avatars(q["users"], q["avatars"]), *cols) == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))
