"""Stand-in quiz tables over the driver's Parquet tables (FIXTURES.md §2).

Each function reads only the columns it needs (Catalyst prunes the Parquet scan to them) and
returns a DataFrame with the quiz schema. These are fixtures: they only rename and derive
columns; the operators in :mod:`quizmart.operators` do the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmart.operators.scan import input_partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def avatars(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("avatar_id"), F.col("n_name").alias("avatar_name"))


def users(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
                    F.col("c_nationkey").cast("int").alias("avatar_id"),
                    F.col("c_mktsegment").alias("segment"))


def courses(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").alias("course_id"), F.col("r_name").alias("course_name"))


def questions(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc_id"), "quality", "toxic")
    j = d.join(lab, d.doc_id == lab.l_doc_id, "left")
    return j.select(
        F.col("doc_id").alias("question_id"),
        (F.col("doc_id") % 4).cast("int").alias("course_id"),
        (F.col("doc_id") % 100).alias("made_by_userid"),
        F.when(F.col("l_doc_id").isNotNull(), F.col("doc_id") % 10).alias("checked_by_adminid"),
        F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved")
         .otherwise("pending").alias("status"),
        F.col("text"))


def answers(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("answer_id"),
                    F.floor(F.col("p_partkey") / 4).cast("bigint").alias("question_id"),
                    F.col("p_name").alias("text"),
                    (F.col("p_partkey") % 4 == 0).alias("right_wrong"))


def games(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("game_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("course_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(st == "O", "waiting").when(st == "P", "active").otherwise("finished").alias("status"),
        F.when(st != "O", F.col("o_orderdate")).alias("start_date"),
        F.when(st == "F", F.col("o_orderdate") + F.expr("INTERVAL 15 MINUTES")).alias("finish_date"))


#: Input bytes of the answers per partition where they are laid out by game: half a million rows.
GAME_BYTES = 8 * 1024 * 1024


def game_answers(spark, sf_dir, by_game: bool = False) -> DataFrame:
    """The answers. ``by_game`` lays them out by game, in partitions by the size of the table: aggregates
    by game and more columns need no further shuffle, and all that a task sorts and hashes in one stage
    (both sides of the join with the games, the aggregates, the joins on them) is bounded, however large
    the partitions are that AQE would make of a narrow shuffle."""
    li = table(spark, sf_dir, "lineitem")
    if by_game:
        li = li.repartition(input_partitions(li, GAME_BYTES), "l_orderkey")
    return game_answers_from(li, table(spark, sf_dir, "orders"))


def game_rounds(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_linenumber") + 10 * F.col("l_orderkey")).alias("round_no"),
        F.col("l_orderkey").alias("game_id"),
        F.floor((F.col("l_orderkey") % 997) / 4).cast("bigint").alias("question_id")).distinct()


def game_groups(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("game_id"), F.col("c_custkey").alias("user_id"),
                    F.floor("c_acctbal").cast("int").alias("score"))


def chats(spark, sf_dir) -> DataFrame:
    cv = table(spark, sf_dir, "conversations")
    return cv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chat_id"),
                     F.col("conv_id").alias("game_id"), F.col("role").alias("username"),
                     F.col("text"), F.col("turn").alias("seq"))


def _kind(event_type: Column) -> Column:
    return (F.when(event_type == "signup", "requestJoin").when(event_type == "error", "disconnect")
            .when(event_type == "view", "page").when(event_type == "click", "answer")
            .otherwise("chat-message"))


def events_from(e: DataFrame, *more: str) -> DataFrame:
    """The events projection on any frame with the driver's events schema (batch or stream)."""
    return e.select("event_id", "ts", "user_id", _kind(F.col("event_type")).alias("kind"),
                    F.get_json_object("props", "$.k").try_cast("int").alias("k"), *more)


def events(spark, sf_dir) -> DataFrame:
    return events_from(table(spark, sf_dir, "events"))


def game_answers_from(li: DataFrame, orders: DataFrame) -> DataFrame:
    """The game_answers projection of a lineitem frame (batch or stream) and the orders table."""
    o = orders.select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("l_orderkey").alias("game_id"), F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("answer_id"), F.col("l_linenumber").alias("round_no"),
        (F.col("l_returnflag") == "R").alias("right_wrong"), F.col("l_shipdate").alias("answered_at"),
        F.col("l_suppkey").alias("tie1"), F.col("l_extendedprice").alias("tie2"),
        F.col("l_quantity").alias("tie3"))
