"""All declared constraints of the quiz schema in one pass per table.

``CONSTRAINTS`` declares the schema; :func:`audited` compiles a table's constraints into one plan that
gives every row the list of rules it breaks: the row rules (NOT NULL, CHECK, length) read the row
alone, each referenced key costs one join with the parent's distinct keys, and each key one
aggregate. :func:`audit` counts the broken rules of all tables, :func:`store_audited` writes good and
bad rows in one job and takes the counts from that job.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quizmart.operators.changes import GAME_STATUSES, QUESTION_STATUSES


class Constraints(NamedTuple):
    """Of one table: columns that are never NULL, unique keys (the first is the primary key), references
    (column -> table, key), CHECK domains, and longest texts."""

    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    refers: dict[str, tuple[str, str]] = {}
    domain: dict[str, list[str]] = {}
    length: dict[str, int] = {}


# The reference's declared schema
CONSTRAINTS: dict[str, Constraints] = {
    "avatars": Constraints(("avatar_id", "avatar_name", "avatar_image_url"), (("avatar_id",),), length={"avatar_name": 50, "avatar_image_url": 255}),
    "users": Constraints(("user_id", "firstname", "surname", "username", "email", "password"), (("user_id",), ("username",), ("email",)),
                         {"avatar_id": ("avatars", "avatar_id")}, length={"firstname": 50, "surname": 50, "username": 30, "email": 100, "password": 255}),
    "admins": Constraints(("admin_id", "username", "email", "password"), (("admin_id",), ("username",), ("email",)), length={"username": 30, "email": 100, "password": 255}),
    "courses": Constraints(("course_id", "course_name"), (("course_id",),), length={"course_name": 100}),
    "questions": Constraints(("question_id", "text"), (("question_id",),),
                             {"course_id": ("courses", "course_id"), "made_by_userid": ("users", "user_id"), "checked_by_adminid": ("admins", "admin_id")},
                             {"status": QUESTION_STATUSES}, {"status": 20}),
    "answers": Constraints(("answer_id", "text", "right_wrong"), (("answer_id",),), {"question_id": ("questions", "question_id")}, length={"text": 255}),
    "game_groups": Constraints(("game_id",), (("game_id",),), {"user_id": ("users", "user_id")}),
    "games": Constraints(("game_id",), (("game_id",),), {"course_id": ("courses", "course_id"), "user_id": ("users", "user_id")}, {"status": GAME_STATUSES}, {"status": 20}),
    "game_rounds": Constraints(("round_no",), (("round_no",),), {"game_id": ("games", "game_id"), "question_id": ("questions", "question_id")}),
    "game_answers": Constraints(("game_answer_id", "right_wrong"), (("game_answer_id",),),
                                {"game_id": ("games", "game_id"), "user_id": ("users", "user_id"), "answer_id": ("answers", "answer_id")}),
    "chats": Constraints(("chat_id", "text"), (("chat_id",),), {"user_id": ("users", "user_id"), "game_id": ("games", "game_id")}),
    "audit_log": Constraints(("log_id", "table_name", "operation"), (("log_id",),), length={"table_name": 50, "operation": 10}),
}


def rule_names(table: str, constraints: Constraints, columns: list[str]) -> list[str]:
    """The rules that apply to a table with these columns; one that names a missing column does not,
    but for a missing NOT NULL column, which is broken by every row."""
    has = set(columns)
    return [*[f"not_null({c})" for c in constraints.not_null], *[f"unique({','.join(k)})" for k in constraints.unique if has >= set(k)],
            *[f"fk({c}->{p}.{k})" for c, (p, k) in constraints.refers.items() if c in has], *[f"domain({c})" for c in constraints.domain if c in has],
            *[f"length({c})>{n}" for c, n in constraints.length.items() if c in has]]


def audited(tables: dict[str, DataFrame], name: str, catalogue: dict[str, Constraints] = CONSTRAINTS) -> DataFrame:
    """Every row of a table with ``broken``, the sorted list of the rules it breaks.

    NULLs break NOT NULL only: a NULL key part, reference or status passes the other rules. A reference to
    a table that is not among ``tables`` is not checked. A key's duplicates are found by an aggregate
    and come back by a join whose table side AQE splits at a hot key; a parent joins by its distinct keys.
    """
    rows, own = tables[name], catalogue[name]
    columns = rows.columns
    names = set(rule_names(name, own, columns))
    broken: list[Column] = []

    def rule(text: str, when: Column) -> None:
        if text in names:
            broken.append(F.when(when, F.lit(text)))

    for c in own.not_null:
        rule(f"not_null({c})", F.col(c).isNull() if c in columns else F.lit(True))
    for c, values in own.domain.items():
        if c in columns:
            rule(f"domain({c})", ~F.col(c).isin(values))
    for c, n in own.length.items():
        if c in columns:
            rule(f"length({c})>{n}", F.char_length(c) > n)
    out = rows
    for i, key in enumerate(k for k in own.unique if set(k) <= set(columns)):
        known = F.lit(True)
        for c in key:
            known = known & F.col(c).isNotNull()
        twice = rows.filter(known).groupBy(*[F.col(c).alias(f"__u{i}_{c}") for c in key]).agg(F.count(F.lit(1)).alias(f"__u{i}")).filter(F.col(f"__u{i}") > 1)
        same = F.lit(True)
        for c in key:
            same = same & (F.col(c) == F.col(f"__u{i}_{c}"))
        out = out.join(twice, same, "left").drop(*[f"__u{i}_{c}" for c in key])
        rule(f"unique({','.join(key)})", F.col(f"__u{i}").isNotNull())
    for i, (c, (parent, key)) in enumerate(own.refers.items()):
        if c not in columns or parent not in tables:
            continue
        keys = tables[parent].select(F.col(key).alias(f"__f{i}_k"), F.lit(True).alias(f"__f{i}")).filter(F.col(f"__f{i}_k").isNotNull()).distinct()
        out = out.join(keys, F.col(c) == F.col(f"__f{i}_k"), "left").drop(f"__f{i}_k")
        rule(f"fk({c}->{parent}.{key})", F.col(c).isNotNull() & F.col(f"__f{i}").isNull())
    return out.select(*columns, F.array_sort(F.array_compact(F.array(*broken))).alias("broken") if broken else F.array().cast("array<string>").alias("broken"))


def audit(tables: dict[str, DataFrame], catalogue: dict[str, Constraints] = CONSTRAINTS) -> DataFrame:
    """(table_name, rule, violations) for every rule that applies to the tables, zeros included."""
    spark = next(iter(tables.values())).sparkSession
    declared = [(t, r) for t, rows in tables.items() for r in rule_names(t, catalogue[t], rows.columns)
                if not r.startswith("fk(") or r[3:-1].split("->")[1].split(".")[0] in tables]
    found = None
    for t in tables:
        one = audited(tables, t, catalogue).select(F.lit(t).alias("table_name"), F.explode("broken").alias("rule"))
        found = one if found is None else found.unionAll(one)
    counts = found.groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("violations"))
    rules = spark.createDataFrame(declared, "table_name string, rule string")
    return rules.join(counts, ["table_name", "rule"], "left").withColumn("violations", F.coalesce("violations", F.lit(0)).cast("long"))


def store_audited(tables: dict[str, DataFrame], name: str, path: str, catalogue: dict[str, Constraints] = CONSTRAINTS, mode: str = "quarantine") -> dict[str, int]:
    """Writes a table's rows to ``path``/ok=true and, with their broken rules, ok=false, in one job, and
    returns the violations per rule as that job has seen them. ``mode='abort'``: the first bad row
    fails the job, and nothing is written."""
    rows = audited(tables, name, catalogue)
    if mode == "abort":
        rows = aborting(rows, F.size("broken") > 0, F.concat_ws(", ", "broken"))
    names = rule_names(name, catalogue[name], tables[name].columns)
    seen = Observation()
    rows = rows.observe(seen, *[F.count_if(F.array_contains("broken", r)).alias(f"r{i}") for i, r in enumerate(names)], F.count(F.lit(1)).alias("rows"))
    rows.withColumn("ok", F.size("broken") == 0).write.mode("overwrite").partitionBy("ok").parquet(path)
    got = seen.get
    return {r: got[f"r{i}"] for i, r in enumerate(names)}


def aborting(rows: DataFrame, bad: Column, message: Column) -> DataFrame:
    """``rows`` that fail the job which computes them at the first row that is ``bad``: the check is
    part of the plan that writes, so a failed statement commits nothing and no other job looks for
    bad rows first."""
    checked = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit("constraint violated: "), message)).cast("boolean")).otherwise(F.lit(True))
    return rows.filter(checked)
