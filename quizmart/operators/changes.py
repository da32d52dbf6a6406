"""Change application: the reference's trigger semantics as set operations.

The reference runs row triggers inside one statement and aborts it on the first bad row; here a
change set is applied as joins and aggregates over whole tables, and bad rows are quarantined
with a ``reason`` (``mode='fail'`` raises instead). ``now`` is always an explicit literal.

Conditions follow PL/pgSQL's three-valued ``IF``: a NULL condition does not fire, so every
predicate below is wrapped in ``coalesce(cond, false)`` where the trigger would have skipped it.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmart.operators.reports import user_scores
from quizmart.operators.scan import _starts, ranged_checkpoint


def _fires(cond: Column) -> Column:
    """PL/pgSQL ``IF cond``: NULL does not fire."""
    return F.coalesce(cond, F.lit(False))


def _lit_ts(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")


def _fail_if_any(rejected: DataFrame, mode: str) -> None:
    if mode == "fail" and (first := rejected.limit(1).collect()):
        raise ValueError("change rejected: " + str(first[0].asDict()))


def or_abort(decisions: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The accepted rows of ``decisions`` (``columns``), as the result of one statement: a row with a
    ``reason`` fails the job that computes them, so whatever that job writes is not committed."""
    text = F.concat(F.lit("change rejected: "), F.col("reason"), F.lit(" "), row_json(decisions))
    passed = F.when(F.col("reason").isNotNull(), F.raise_error(text).cast("boolean")).otherwise(F.lit(True))
    return decisions.filter(passed).select(*columns)


# ---------------------------------------------------------------------------- D5
def score_all(game_answers: DataFrame, answers: DataFrame) -> DataFrame:
    """D5 lookup: every answer with ``right_wrong`` replaced by the answer table's truth (NULL
    when the answer_id is unknown or NULL) — one left join."""
    truth = answers.select(F.col("answer_id").alias("__aid"), F.col("right_wrong").alias("__truth"))
    j = game_answers.join(truth, game_answers["answer_id"] == truth["__aid"], "left")
    return j.withColumn("right_wrong", F.col("__truth")).drop("__aid", "__truth")


def score_answers(game_answers: DataFrame, answers: DataFrame, mode: str = "quarantine"):
    """Look up ``right_wrong`` by answer_id and **override** the supplied value.

    Returns ``(accepted, rejected)``; an unknown or NULL answer_id yields a NULL truth, which the
    reference's NOT NULL constraint rejects (``reason = 'unknown_answer'``).
    """
    scored = score_all(game_answers, answers)
    accepted = scored.filter(F.col("right_wrong").isNotNull())
    rejected = scored.filter(F.col("right_wrong").isNull()).withColumn("reason", F.lit("unknown_answer"))
    _fail_if_any(rejected, mode)
    return accepted, rejected


# ---------------------------------------------------------------------------- F5
def _partition_edges(keys: list[str]):
    """Arrow pass over a sorted partition: the keys of its first and of its last row, one row."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = None
        for batch in batches:
            if batch.num_rows:
                lo, hi = lo or batch.slice(0, 1), batch.slice(batch.num_rows - 1, 1)
        if hi is not None:
            at = [hi.schema.names.index(k) for k in keys]
            pid = hi.schema.names.index("__pid")
            yield pa.RecordBatch.from_arrays([hi.column(pid), *[lo.column(i) for i in at], *[hi.column(i) for i in at]],
                                             names=["__pid", *[f"__lo{i}" for i in range(len(keys))], *[f"__hi{i}" for i in range(len(keys))]])
    return fn


def _mark_batches(keys: list[str], out: str):
    """Arrow pass over a sorted partition: whether a row is the first of its key, which ``__goes`` says
    of the partition's first row."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key of the last row seen
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.schema.names
            columns = [batch.column(names.index(k)) for k in keys]
            first = _starts(columns, n)
            if last is None:
                first[0] = not batch.column(names.index("__goes"))[0].as_py()
            else:  # compared as the rows of a batch are
                first[0] = _starts([pa.concat_arrays([x, c.slice(0, 1)]) for x, c in zip(last, columns, strict=True)], 2)[1]
            last = [c.slice(n - 1, 1) for c in columns]
            first &= ~np.asarray(batch.column(names.index("__skip")))
            kept = [i for i, x in enumerate(names) if x not in ("__skip", "__goes")]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(first)], names=[*[names[i] for i in kept], out])
    return fn


def mark_first(rows: DataFrame, keys: Iterable[str], order: Iterable[str], eligible: Column | None = None,
               null_safe: bool = True, out: str = "__first") -> DataFrame:
    """``rows`` with ``out``: the row is its key's first among the ``eligible`` rows. "First" is the
    minimum by ``order``, then by all other columns, so rows that tie are identical and any one of them
    is taken. Without ``null_safe`` a row with a NULL key part is not eligible.

    The rows are shuffled once, into ranges of (not eligible, key, order, other columns) that are
    checkpointed, so that a key of any size is spread over as many of them as it fills. A row is its key's
    first where the key differs from the row before; a partition's first row also needs that no earlier
    partition ends with its key, which one row per partition tells.
    """
    keys, order = list(keys), list(order)
    fit = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    for k in [] if null_safe else keys:
        fit = fit & F.col(k).isNotNull()
    others = [c for c in rows.columns if c not in keys and c not in order]
    ranged = ranged_checkpoint(rows.withColumn("__skip", ~fit), ["__skip", *keys, *[c for c in order if c not in keys], *others])
    n = len(keys)
    kinds = [ranged.schema[k].dataType for k in keys]
    schema = T.StructType([T.StructField("__pid", T.IntegerType()), *[T.StructField(f"__{side}{i}", kinds[i]) for side in ("lo", "hi") for i in range(n)]])
    edges = ranged.filter(~F.col("__skip")).select(F.spark_partition_id().alias("__pid"), *keys).mapInArrow(_partition_edges(keys), schema)
    ends = edges.groupBy(*[f"__hi{i}" for i in range(n)]).agg(F.min("__pid").alias("__from"))
    cond = F.col("__from") < F.col("__pid")
    for i in range(n):
        cond = cond & F.col(f"__lo{i}").eqNullSafe(F.col(f"__hi{i}"))
    goes = edges.drop(*[f"__hi{i}" for i in range(n)]).join(ends, cond, "left_semi").select(F.col("__pid").alias("__p"), F.lit(True).alias("__goes"))
    tagged = ranged.withColumn("__pid", F.spark_partition_id()).join(F.broadcast(goes), F.col("__pid") == F.col("__p"), "left").drop("__pid", "__p")
    marked = tagged.mapInArrow(_mark_batches(keys, out), T.StructType([*rows.schema.fields, T.StructField(out, T.BooleanType())]))
    return marked


def first_per_key(rows: DataFrame, keys: Iterable[str], order: Iterable[str], null_safe: bool = True):
    """Split ``rows`` into (first row per key, the rest) — exact as multisets (:func:`mark_first`)."""
    marked = mark_first(rows, keys, order, null_safe=null_safe)
    first = F.coalesce(F.col("__first"), F.lit(False))
    return marked.filter(first).drop("__first"), marked.filter(~first).drop("__first")


def round_answer_decisions(incoming: DataFrame, existing: DataFrame | None = None,
                           keys: Iterable[str] = ("game_id", "user_id", "round_no"),
                           order: Iterable[str] = ("answered_at",), scored: bool = False,
                           prune_existing: bool = False) -> DataFrame:
    """Every incoming row with its ``reason`` (NULL = accepted):

    * ``unknown_answer`` (only with ``scored``): the looked-up ``right_wrong`` is NULL;
    * ``duplicate_existing``: the key is present in ``existing``;
    * ``duplicate_in_batch``: another row of the key comes first by ``order``, then all columns;
    * a row with a NULL key part never counts as a duplicate (``WHERE a = NULL`` matches nothing).

    ``prune_existing`` (a small batch against a long history) restricts the stored keys to those of
    the batch by a semi join that AQE can broadcast, instead of shuffling the history whole.
    """
    keys = list(keys)
    nn = F.lit(True)
    for k in keys:
        nn = nn & F.col(k).isNotNull()
    flagged = incoming.withColumn("__ex", F.lit(None).cast("boolean"))
    if existing is not None:
        ex = existing.select(*keys).filter(nn)
        if prune_existing:
            ex = ex.join(incoming.select(*keys).filter(nn).distinct(), keys, "left_semi")
        flagged = incoming.join(ex.distinct().withColumn("__ex", F.lit(True)), keys, "left").select(*incoming.columns, "__ex")
    known = F.col("right_wrong").isNotNull() if scored else F.lit(True)
    marked = mark_first(flagged, keys, list(order), eligible=nn & known & F.col("__ex").isNull(), null_safe=False)
    reason = (F.when(~known, F.lit("unknown_answer")).when(nn & F.col("__ex"), F.lit("duplicate_existing"))
              .when(nn & ~F.col("__first"), F.lit("duplicate_in_batch")))
    return marked.withColumn("reason", reason).select(*incoming.columns, "reason")


def duplicate_round_answers(incoming: DataFrame, existing: DataFrame | None = None,
                            keys: Iterable[str] = ("game_id", "user_id", "round_no"),
                            order: Iterable[str] = ("answered_at",), mode: str = "quarantine",
                            prune_existing: bool = False):
    """first answer per (game, user, round) wins; returns ``(accepted, rejected)``, the two
    sides of :func:`round_answer_decisions`."""
    dec = round_answer_decisions(incoming, existing, keys, order, prune_existing=prune_existing)
    rejected = dec.filter(F.col("reason").isNotNull())
    _fail_if_any(rejected, mode)
    return dec.filter(F.col("reason").isNull()).drop("reason"), rejected


# ---------------------------------------------------------------------------- J4, J5
def ingest_decisions(existing: DataFrame, incoming: DataFrame, answers: DataFrame,
                     order: Iterable[str] = ("answered_at",)) -> DataFrame:
    """Every incoming row scored (D5) with its ``reason`` (NULL = accepted): one lookup join, one
    duplicate check."""
    return round_answer_decisions(score_all(incoming, answers), existing, order=order, scored=True)


def ingest_answers(existing: DataFrame, incoming: DataFrame, answers: DataFrame, games: DataFrame,
                   order: Iterable[str] = ("answered_at",), points_per_right: int = 10,
                   mode: str = "quarantine"):
    """The insert cascade — score (D5), then duplicate check (F5; triggers of equal timing
    fire in name order, auto-score first), then the users' score totals (E3) over the new table.

    Returns ``(accepted, rejected, scores)``.
    """
    dec = ingest_decisions(existing, incoming, answers, order)
    accepted, rejected = dec.filter(F.col("reason").isNull()).drop("reason"), dec.filter(F.col("reason").isNotNull())
    _fail_if_any(rejected, mode)
    table = existing.unionByName(accepted.select(*existing.columns))
    scores = user_scores(table, games, points_per_right)
    return accepted, rejected, scores


def merge_scores(scores: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored totals plus the points of newly accepted answers; a user of either side has a row."""
    both = scores.select("user_id", "score").unionByName(delta.select("user_id", "score"))
    return both.groupBy("user_id").agg(F.sum("score").cast("bigint").alias("score"))


def ingest_delta(stored_keys: DataFrame, incoming: DataFrame, answers: DataFrame, games: DataFrame, scores: DataFrame,
                 order: Iterable[str] = ("answered_at",), points_per_right: int = 10, mode: str = "quarantine"):
    """J4 without a look at the answer history: scores and checks ``incoming`` (its keys against those of
    ``stored_keys`` that the batch names) and adds the accepted answers' points to the stored ``scores``.

    Returns ``(accepted, rejected, delta, scores)``; scores equal the totals over the whole history as long
    as every accepted answer went through here. All of these read the decisions' own checkpoint
    (:func:`mark_first`).
    """
    dec = round_answer_decisions(score_all(incoming, answers), stored_keys, order=order, scored=True, prune_existing=True)
    accepted, rejected = dec.filter(F.col("reason").isNull()).drop("reason"), dec.filter(F.col("reason").isNotNull())
    _fail_if_any(rejected, mode)
    delta = user_scores(accepted, games, points_per_right)
    return accepted, rejected, delta, merge_scores(scores, delta)


def refresh_group_scores(game_groups: DataFrame, scores: DataFrame) -> DataFrame:
    """Every group row of a user with a computed score gets it; other rows keep theirs."""
    s = scores.select(F.col("user_id").alias("__uid"), F.col("score").alias("__score"))
    j = game_groups.join(s, game_groups["user_id"] == s["__uid"], "left")
    return j.withColumn("score", F.coalesce(F.col("__score").cast(game_groups.schema["score"].dataType),
                                            F.col("score"))).drop("__uid", "__score")


# ---------------------------------------------------------------------------- J1, J2, J3
def _old_new(current: DataFrame, changes: DataFrame, key: str):
    """Every current row with its change (``changes`` holds one row per key here) as ``old_*`` /
    ``new_*`` columns and ``__has`` = a change exists. One left join serves both the per-change
    decisions and the new snapshot. A column absent from ``changes`` is unchanged (NEW = OLD);
    a change for a key that does not exist updates nothing."""
    old = current.select(*[F.col(c).alias(f"old_{c}") for c in current.columns])
    chg = changes.select(*[F.col(c).alias(f"chg_{c}") for c in changes.columns]).withColumn("__has", F.lit(True))
    j = old.join(chg, F.col(f"old_{key}") == F.col(f"chg_{key}"), "left")
    has = F.coalesce(F.col("__has"), F.lit(False))
    for c in current.columns:
        new = F.when(has, F.col(f"chg_{c}")).otherwise(F.col(f"old_{c}")) if c in changes.columns else F.col(f"old_{c}")
        j = j.withColumn(f"new_{c}", new)
    return j.drop(*[f"chg_{c}" for c in changes.columns]).withColumn("__has", has)


def _split(j: DataFrame, current: DataFrame, key: str, reason: Column, mode: str):
    """(snapshot, decisions, rejected): the snapshot takes the new row where the change is
    accepted and keeps the old row otherwise; decisions hold one row per applied change."""
    j = j.withColumn("reason", F.when(F.col("__has"), reason))
    decisions = j.filter(F.col("__has")).drop("__has")
    rejected = decisions.filter(F.col("reason").isNotNull())
    _fail_if_any(rejected, mode)
    take_new = F.col("__has") & F.col("reason").isNull()
    snapshot = j.select(*[F.when(take_new, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c)
                          for c in current.columns])
    return snapshot, decisions, rejected


def _one_change(changes: DataFrame, key: str, order: Iterable[str]):
    """(first change of each key, the later ones): a key's changes after its first one in ``order``
    (then by all columns) cannot be applied in the same pass and are quarantined."""
    first, later = first_per_key(changes, [key], list(order))
    return first.drop(*order), later.drop(*order)


def _with_later(decisions: DataFrame, rejected: DataFrame, later: DataFrame, current: DataFrame, key: str, mode: str):
    """Adds the later changes of a key as decisions with reason ``duplicate_change``."""
    old = current.select(*[F.col(c).alias(f"old_{c}") for c in current.columns])
    new = later.select(*[F.col(c).alias(f"chg_{c}") for c in later.columns])
    j = old.join(new, F.col(f"old_{key}") == F.col(f"chg_{key}"))
    dup = j.select(*[F.col(c) for c in old.columns],
                   *[(F.col(f"chg_{c}") if c in later.columns else F.col(f"old_{c}")).alias(f"new_{c}") for c in current.columns],
                   F.lit("duplicate_change").alias("reason"))
    _fail_if_any(dup, mode)
    return decisions.unionByName(dup), rejected.unionByName(dup)


GAME_STATUSES = ["waiting", "active", "finished"]
QUESTION_STATUSES = ["pending", "approved", "rejected"]


def apply_game_status(games: DataFrame, changes: DataFrame, now, mode: str = "quarantine",
                      order: Iterable[str] = ()):
    """Validate status transitions, stamp start/finish dates, then the status CHECK.

    Returns ``(snapshot, decisions, rejected)``; ``decisions`` has one row per change with
    ``old_*``, ``new_*`` and ``reason`` (NULL = applied). With ``order`` (columns of ``changes``) a
    game may have several changes: the first is applied, later ones are ``duplicate_change``;
    without it ``changes`` holds one row per game_id.
    """
    now = _lit_ts(now)
    later = None
    if order:
        changes, later = _one_change(changes, "game_id", order)
    j = _old_new(games, changes, "game_id")
    o, n = F.col("old_status"), F.col("new_status")
    reason = (F.when(_fires(o.isNotNull() & (o == "waiting") & ~n.isin("waiting", "active", "finished")),
                     F.lit("transition"))
              .when(_fires(o.isNotNull() & (o == "active") & ~n.isin("active", "finished")), F.lit("transition"))
              .when(_fires(o.isNotNull() & (o == "finished") & (n != "finished")), F.lit("finished_is_final"))
              .when(_fires(~n.isin(*GAME_STATUSES)), F.lit("domain")))
    j = (j.withColumn("new_start_date", F.when(_fires((n == "active") & (o != "active") & F.col("new_start_date").isNull()),
                                               now).otherwise(F.col("new_start_date")))
          .withColumn("new_finish_date", F.when(_fires((n == "finished") & (o != "finished")
                                                       & F.col("new_finish_date").isNull()), now)
                      .otherwise(F.col("new_finish_date"))))
    snapshot, decisions, rejected = _split(j, games, "game_id", reason, mode)
    if later is not None:
        decisions, rejected = _with_later(decisions, rejected, later, games, "game_id", mode)
    return snapshot, decisions, rejected


def apply_question_review(questions: DataFrame, changes: DataFrame, now, mode: str = "quarantine",
                          order: Iterable[str] = ()):
    """Pending → approved/rejected needs an admin (else rejected) and stamps check_date if
    NULL; other transitions are not checked. Then the status CHECK. ``order``: as in J1."""
    now = _lit_ts(now)
    later = None
    if order:
        changes, later = _one_change(changes, "question_id", order)
    j = _old_new(questions, changes, "question_id")
    o, n = F.col("old_status"), F.col("new_status")
    reviewed = _fires(n.isin("approved", "rejected") & (o == "pending"))
    reason = (F.when(reviewed & F.col("new_checked_by_adminid").isNull(), F.lit("admin_required"))
              .when(_fires(~n.isin(*QUESTION_STATUSES)), F.lit("domain")))
    if "new_check_date" not in j.columns:
        j = j.withColumn("new_check_date", F.lit(None).cast("timestamp_ntz"))
        j = j.withColumn("old_check_date", F.lit(None).cast("timestamp_ntz"))
    j = j.withColumn("new_check_date", F.when(reviewed & F.col("new_check_date").isNull(), now)
                     .otherwise(F.col("new_check_date")))
    if "check_date" not in questions.columns:
        questions = questions.withColumn("check_date", F.lit(None).cast("timestamp_ntz"))
    snapshot, decisions, rejected = _split(j, questions, "question_id", reason, mode)
    if later is not None:
        decisions, rejected = _with_later(decisions, rejected, later, questions, "question_id", mode)
    return snapshot, decisions, rejected


def touch_updated_at(current: DataFrame, changes: DataFrame, key: str, now, order: Iterable[str] = ()) -> DataFrame:
    """Every updated row gets ``updated_at = now`` — even when the values are unchanged.
    Returns the updated rows (new values). With ``order`` a key may have several changes; applied
    one after another, the last one's values remain (an aggregate before the join)."""
    order = list(order)
    if order:
        given = [c for c in changes.columns if c != key and c not in order]
        values = F.struct(*[F.col(c) for c in given])
        last = changes.groupBy(key).agg(F.max(F.struct(*order, values.alias("__v"))).alias("__m"))
        changes = last.select(key, *[F.col(f"__m.__v.{c}").alias(c) for c in given])
    cur = current if "updated_at" in current.columns else current.withColumn(
        "updated_at", F.lit(None).cast("timestamp_ntz"))
    j = _old_new(cur, changes, key).filter(F.col("__has"))
    return j.select(*[F.col(f"new_{c}").alias(c) for c in cur.columns]).withColumn("updated_at", _lit_ts(now))


# ---------------------------------------------------------------------------- J6, J8
def set_status(df: DataFrame, updates: DataFrame, key: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Moderation — set ``status`` by id; unknown ids are ignored; the last update wins
    (by ``ts`` then ``tie``). Carries an optional ``reason`` column when updates have one."""
    order = F.struct(F.col(ts), *( [F.col(tie)] if tie else []))
    vals = ["status"] + (["reason"] if "reason" in updates.columns else [])
    last = updates.groupBy(F.col(key).alias("__k")).agg(
        F.max_by(F.struct(*[F.col(v) for v in vals]), order).alias("__u"))
    j = df.join(last, df[key] == last["__k"], "left")
    out = j.withColumn("status", F.coalesce(F.col("__u.status"), F.col("status")))
    if "reason" in vals:
        stored = F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")
        out = out.withColumn("reason", F.when(F.col("__k").isNotNull(), F.col("__u.reason")).otherwise(stored))
    return out.drop("__k", "__u")


def patch_profile(profiles: DataFrame, patches: DataFrame, key: str,
                  fields: Iterable[str], password_field: str = "password", order: Iterable[str] = ()) -> DataFrame:
    """A given field (empty string counts as given) overrides, an absent (NULL) one keeps the
    stored value; the password only changes when non-empty. Profiles without a patch stay. With
    ``order`` a user may have several patches, applied one after another: of each field the last
    given value remains (one aggregate per user before the join)."""
    fields, order = list(fields), list(order)
    given = [f for f in fields if f in patches.columns]
    value = {f: F.nullif(F.col(f), F.lit("")) if f == password_field else F.col(f) for f in given}
    if order:
        last = [F.max(F.when(value[f].isNotNull(), F.struct(*order, value[f].alias("__v")))).alias(f) for f in given]
        patches = patches.groupBy(key).agg(*last).select(key, *[F.col(f"{f}.__v").alias(f) for f in given])
    p = patches.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__p_{f}") for f in given])
    j = profiles.join(p, profiles[key] == p["__k"], "left")
    for f in fields:
        if f"__p_{f}" not in j.columns:
            continue
        new = F.nullif(F.col(f"__p_{f}"), F.lit("")) if f == password_field else F.col(f"__p_{f}")
        j = j.withColumn(f, F.coalesce(new, F.col(f)))
    return j.drop("__k", *[c for c in j.columns if c.startswith("__p_")])


# ---------------------------------------------------------------------------- J7
def row_json(df: DataFrame, cols: Iterable[str] | None = None) -> Column:
    """I4: the row as a JSON document that keeps NULL fields (``row_to_json``)."""
    cols = list(cols or df.columns)
    return F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})


def audit_diff(old: DataFrame, new: DataFrame, keys: Iterable[str], table_name: str, now) -> DataFrame:
    """Change log between two snapshots — INSERT, UPDATE (only rows that differ, NULL-safe),
    DELETE — with ``old_values``/``new_values`` JSON (NULL fields kept); ``user_id`` is NULL."""
    keys = list(keys)
    cols = old.columns
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("__o"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("__n"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    j = o.join(n, cond, "full_outer")
    ostruct = F.struct(*[F.col(f"o_{c}").alias(c) for c in cols])
    nstruct = F.struct(*[F.col(f"n_{c}").alias(c) for c in cols])
    op = (F.when(F.col("__o").isNull(), F.lit("INSERT")).when(F.col("__n").isNull(), F.lit("DELETE"))
          .when(~ostruct.eqNullSafe(nstruct), F.lit("UPDATE")))
    opts = {"ignoreNullFields": "false"}
    out = j.withColumn("operation", op).filter(F.col("operation").isNotNull())
    return out.select(
        *[F.coalesce(F.col(f"n_{k}"), F.col(f"o_{k}")).alias(k) for k in keys],
        F.lit(table_name).alias("table_name"), F.col("operation"), F.lit(None).cast("int").alias("user_id"),
        F.when(F.col("operation") != "INSERT", F.to_json(ostruct, opts)).alias("old_values"),
        F.when(F.col("operation") != "DELETE", F.to_json(nstruct, opts)).alias("new_values"),
        _lit_ts(now).alias("timestamp"))


# ---------------------------------------------------------------------------- J9, J10
RETENTION_DIRECT = "24 hours"
RETENTION_BACKUP = "21 days"


def retention_tier(log: DataFrame, now, ts: str = "ts") -> DataFrame:
    """Access-log retention — ≤ 24 h: 'direct'; ≤ 3 weeks: 'backup'; older: 'delete'."""
    now = _lit_ts(now)
    t = F.col(ts)
    tier = (F.when(t >= now - F.expr(f"INTERVAL {RETENTION_DIRECT}"), F.lit("direct"))
            .when(t >= now - F.expr(f"INTERVAL {RETENTION_BACKUP}"), F.lit("backup"))
            .otherwise(F.lit("delete")))
    return log.withColumn("tier", tier)


def erase_users(rows: DataFrame, user_ids: DataFrame, user_col: str = "user_id",
                null_cols: Iterable[str] = ()) -> DataFrame:
    """Right to erasure. With ``null_cols`` empty, drop rows keyed by an erased user;
    otherwise keep the rows and NULL those reference columns where they name an erased user."""
    ids = user_ids.select(F.col("user_id").alias("__erase")).distinct()
    null_cols = list(null_cols)
    if not null_cols:
        return rows.join(ids, rows[user_col] == ids["__erase"], "left_anti")
    out = rows
    for c in null_cols:
        e = ids.select(F.col("__erase").alias(f"__e_{c}"))
        out = out.join(e, out[c] == e[f"__e_{c}"], "left")
        out = out.withColumn(c, F.when(F.col(f"__e_{c}").isNull(), F.col(c))).drop(f"__e_{c}")
    return out


def erase_everywhere(tables: dict[str, tuple[DataFrame, str | None, Iterable[str]]], user_ids: DataFrame) -> dict[str, DataFrame]:
    """J10 over all user-keyed tables: name → (rows, owner column or None, reference columns).

    Rows owned by an erased user are dropped; then reference columns that name one become NULL."""
    out = {}
    for name, (rows, owner, refs) in tables.items():
        kept = erase_users(rows, user_ids, owner) if owner else rows
        out[name] = erase_users(kept, user_ids, null_cols=refs) if list(refs) else kept
    return out
