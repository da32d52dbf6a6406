"""Data-quality operators: the reference's schema constraints and quiz rules as quarantine jobs

Each ``violations_*`` returns the offending rows with a ``rule`` column instead of aborting a
statement. ``check(df, mode='fail')`` turns a non-empty result into an error.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmart.operators.scan import sequence_number


def check(violations: DataFrame, mode: str = "quarantine") -> DataFrame:
    """``mode='fail'`` raises when any violation exists (one job that stops at the first row; to check
    in the writing job itself, see ``audit.aborting``)."""
    if mode == "fail" and (first := violations.limit(1).collect()):
        raise ValueError("constraint violated: " + str(first[0].asDict()))
    return violations


def violations_not_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """B1: one row per (row, NULL column) with ``rule = 'not_null(<col>)'``; one scan of ``df``."""
    cols = list(cols)
    rules = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"not_null({c})")) for c in cols]))
    return df.withColumn("rule", F.explode(rules))


def violations_unique(df: DataFrame, cols: Iterable[str], name: str | None = None) -> DataFrame:
    """B2: rows whose key occurs more than once; keys with a NULL part never collide (SQL UNIQUE).

    Duplicate keys are found with an aggregate (map-side combined, so a hot key is one row per
    task) and joined back; AQE splits a skewed key on the big side of that join.
    """
    cols = list(cols)
    nn = F.lit(True)
    for c in cols:
        nn = nn & F.col(c).isNotNull()
    base = df.filter(nn)
    dups = base.groupBy(*cols).agg(F.count(F.lit(1)).alias("key_count")).filter("key_count > 1")
    rule = f"unique({name or ','.join(cols)})"
    return base.join(dups, cols, "inner").withColumn("rule", F.lit(rule))


def violations_fk(child: DataFrame, fk: str | list[str], parent: DataFrame, pk: str | list[str],
                  name: str | None = None) -> DataFrame:
    """Child rows whose (non-NULL) foreign key has no parent row."""
    fk = [fk] if isinstance(fk, str) else list(fk)
    pk = [pk] if isinstance(pk, str) else list(pk)
    nn = F.lit(True)
    for c in fk:
        nn = nn & F.col(c).isNotNull()
    keys = parent.select(*[F.col(p).alias(f"__pk{i}") for i, p in enumerate(pk)])
    cond = F.lit(True)
    for i, c in enumerate(fk):
        cond = cond & (F.col(c) == F.col(f"__pk{i}"))
    rule = f"fk({name or ','.join(fk)}->{','.join(pk)})"
    return child.filter(nn).join(keys, cond, "left_anti").withColumn("rule", F.lit(rule))


def violations_domain(df: DataFrame, col: str, values: Iterable[str]) -> DataFrame:
    """CHECK (col IN values); NULL passes, as in SQL."""
    values = list(values)
    return df.filter(~F.col(col).isin(values)).withColumn("rule", F.lit(f"domain({col})"))


def violations_length(df: DataFrame, col: str, n: int) -> DataFrame:
    """varchar(n) / maxlength — more than ``n`` characters."""
    return df.filter(F.char_length(F.col(col)) > n).withColumn("rule", F.lit(f"length({col})>{n}"))


def apply_defaults(df: DataFrame, defaults: dict[str, Column | object]) -> DataFrame:
    """A column default applies only when the column is absent; an explicit NULL stays."""
    out = df
    for c, v in defaults.items():
        if c not in df.columns:
            out = out.withColumn(c, v if isinstance(v, Column) else F.lit(v))
    return out


def assign_surrogate_key(df: DataFrame, key: str, order_by: Iterable[str], start: Column | int = 1,
                         existing: DataFrame | None = None, existing_key: str | None = None) -> DataFrame:
    """Serial ids in ``order_by`` order continuing after ``max(existing.key)`` (or from ``start``).

    The position is a two-phase global scan (range partitions + bounded carry table), not a
    single-partition ``row_number()`` window.
    """
    seq = sequence_number(df, [], list(order_by), "__seq")
    if existing is not None:
        mx = existing.agg(F.max(existing_key or key).alias("__mx")).withColumn("__one", F.lit(1))
        base = seq.withColumn("__one", F.lit(1)).join(F.broadcast(mx), "__one").drop("__one")  # one-row side
        offset = F.coalesce(F.col("__mx"), F.lit(0))
        return base.withColumn(key, offset + F.col("__seq")).drop("__seq", "__mx")
    s = start if isinstance(start, Column) else F.lit(start)
    return seq.withColumn(key, s + F.col("__seq") - 1).drop("__seq")


def violations_quiz_shape(games: DataFrame, rounds: DataFrame, questions: DataFrame,
                          answers: DataFrame, players: DataFrame, rounds_per_game: int = 5,
                          answers_per_question: int = 4, max_players: int = 5) -> DataFrame:
    """Quiz rules stated by the reference — 5 rounds per finished game, 4 answers per question
    with exactly one right, at most 5 players in a game (a player is a user who answered in it or is
    in one of its groups). Output: (rule, entity_id, n)."""
    r = rounds.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    fin = games.filter(F.col("status") == "finished").select("game_id")
    bad_rounds = (fin.join(r, "game_id", "left")
                  .select(F.lit("rounds_per_finished_game").alias("rule"),
                          F.col("game_id").cast("bigint").alias("entity_id"),
                          F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
                  .filter(F.col("n") != rounds_per_game))
    a = answers.groupBy("question_id").agg(F.count(F.lit(1)).alias("na"),
                                           F.count_if(F.col("right_wrong")).alias("nr"))
    qa = questions.select("question_id").join(a, "question_id", "left")
    bad_answers = qa.select(F.lit("answers_per_question").alias("rule"),
                            F.col("question_id").cast("bigint").alias("entity_id"),
                            F.coalesce("na", F.lit(0)).cast("bigint").alias("n")).filter(
        F.col("n") != answers_per_question)
    bad_right = qa.select(F.lit("one_right_answer").alias("rule"),
                          F.col("question_id").cast("bigint").alias("entity_id"),
                          F.coalesce("nr", F.lit(0)).cast("bigint").alias("n")).filter(F.col("n") != 1)
    bad_group = (players.select("game_id", "user_id").distinct().groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
                 .filter(F.col("n") > max_players)
                 .select(F.lit("players_per_game").alias("rule"),
                         F.col("game_id").cast("bigint").alias("entity_id"), F.col("n").cast("bigint")))
    return bad_rounds.unionByName(bad_answers).unionByName(bad_right).unionByName(bad_group)


def unapproved_in_play(rounds: DataFrame, questions: DataFrame) -> DataFrame:
    """Rounds whose question is not 'approved' (missing questions count as not approved)."""
    ok = questions.filter(F.col("status") == "approved").select("question_id")
    return rounds.join(ok, "question_id", "left_anti")


def playable_questions(questions: DataFrame, rounds: DataFrame) -> DataFrame:
    """D8 semi form: approved questions that are used in at least one round."""
    used = rounds.select("question_id")
    return questions.filter(F.col("status") == "approved").join(used, "question_id", "left_semi")


def align_rounds(rounds: DataFrame, game_answers: DataFrame, answers: DataFrame) -> DataFrame:
    """Match answers to rounds by position within the game (trap: ``game_rounds.round_no`` is
    a global serial, ``game_answers.round_no`` counts 1..5 per game).

    Round position = rank of the round by round_no within its game; an answer's position is its
    own round_no. Output per matched answer: the round's question, the answered question and
    ``question_match``. Positions come from the skew-proof scan, not a per-game window.
    """
    pos = sequence_number(rounds.select("game_id", "round_no", "question_id"), ["game_id"], ["round_no"],
                          "position")
    r = pos.select("game_id", "position", F.col("round_no").alias("round_serial"),
                   F.col("question_id").alias("round_question_id"))
    ga = game_answers.join(answers.select("answer_id", F.col("question_id").alias("answer_question_id")),
                           "answer_id", "left")
    j = ga.join(r, (ga.game_id == r.game_id) & (ga.round_no == r.position), "inner").drop(r.game_id)
    return j.withColumn("question_match", F.col("round_question_id").eqNullSafe(F.col("answer_question_id")))
