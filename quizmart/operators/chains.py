"""Several changes of one row in one change set, applied in turn.

A row trigger sees the changes of a row one after another: each is judged against what the accepted
ones before it have left. A row's state is its status and which of its time stamps are set, so a
change is a function from states to states, and changes in sequence compose. The changes are laid out
by (key, order) over range partitions; every partition composes the changes of its last key,
which alone can go on in the next one; a fold over these compositions (one per partition) gives the
state that each partition starts from, and one more pass applies the changes. No task needs all
changes of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmart.operators.changes import GAME_STATUSES, QUESTION_STATUSES, _fail_if_any, _lit_ts
from quizmart.operators.scan import _starts, ranged_checkpoint

OTHER = "\0other"  # any status outside the domain
#: How a change treats a stamp column: leaves it alone, clears it, or gives it.
KEEP, CLEAR, GIVE = 0, 1, 2


class Rules(NamedTuple):
    """Statuses of the domain, stamp columns, and ``decide(old, new, stamped, extra)`` -> (reason or
    None, which stamps to set); ``stamped`` says which stamps the new row has before that."""

    statuses: list[str]
    stamps: list[str]
    decide: Callable[[str | None, str | None, tuple[bool, ...], bool], tuple[str | None, tuple[bool, ...]]]


def decide_game(old: str | None, new: str | None, stamped: tuple[bool, ...], extra: bool):
    """J1. A NULL on either side passes the comparisons, as in a three-valued IF."""
    reason = None
    if old == "waiting" and new not in (None, "waiting", "active", "finished"):
        reason = "transition"
    elif old == "active" and new not in (None, "active", "finished"):
        reason = "transition"
    elif old == "finished" and new not in (None, "finished"):
        reason = "finished_is_final"
    elif new == OTHER:
        reason = "domain"
    entered = old is not None and new != old
    return reason, (entered and new == "active" and not stamped[0], entered and new == "finished" and not stamped[1])


def decide_review(old: str | None, new: str | None, stamped: tuple[bool, ...], extra: bool):
    """J2. ``extra``: the new row names an admin."""
    reviewed = old == "pending" and new in ("approved", "rejected")
    reason = "admin_required" if reviewed and not extra else "domain" if new == OTHER else None
    return reason, (reviewed and not stamped[0],)


GAME = Rules(GAME_STATUSES, ["start_date", "finish_date"], decide_game)
REVIEW = Rules(QUESTION_STATUSES, ["check_date"], decide_review)


class _Tables(NamedTuple):
    """Of every (row code, state): next state, whether the change is accepted, reason, stamps set."""

    next: np.ndarray
    accepted: np.ndarray
    reason: list[list[str | None]]
    stamps: np.ndarray


def _tables(rules: Rules) -> _Tables:
    values = [*rules.statuses, None, OTHER]
    k = len(rules.stamps)
    bits = list(product((False, True), repeat=k))
    states = [(v, b) for v in values for b in bits]
    number = {s: i for i, s in enumerate(states)}
    nxt, accepted, reasons, stamps = [], [], [], []
    for new, extra, *modes in product(values, (False, True), *[(KEEP, CLEAR, GIVE)] * k):
        row = []
        for old, held in states:
            before = tuple(h if m == KEEP else m == GIVE for h, m in zip(held, modes, strict=True))
            reason, stamp = rules.decide(old, new, before, extra)
            after = tuple(b or s for b, s in zip(before, stamp, strict=True))
            row.append((number[(old, held) if reason else (new, after)], reason is None, reason, sum(1 << i for i, s in enumerate(stamp) if s)))
        for out, column in zip((nxt, accepted, reasons, stamps), zip(*row, strict=True), strict=True):
            out.append(list(column))
    return _Tables(np.array(nxt, np.int32), np.array(accepted), reasons, np.array(stamps, np.int32))


def _status_code(status: Column, rules: Rules) -> Column:
    out = F.when(status.isNull(), len(rules.statuses))
    for i, s in enumerate(rules.statuses):
        out = out.when(status == s, i)
    return out.otherwise(len(rules.statuses) + 1)


def _state_code(rules: Rules, status: Column, stamps: list[Column]) -> Column:
    code = _status_code(status, rules)
    for s in stamps:
        code = code * 2 + s.isNotNull().cast("int")
    return code.cast("int")


def _last_compositions(key: str, given: list[str], tables: _Tables):
    """Arrow pass over a sorted partition: of its last key, the state after its changes and the values
    of the last accepted one, for every state before them."""
    n = tables.next.shape[1]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, exits, values, start = None, None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            keys = batch.column(names.index(key))
            codes = batch.column(names.index("__row")).to_pylist()
            at = int(np.flatnonzero(_starts([keys], batch.num_rows))[-1])
            if at or keys[0].as_py() != last:
                exits, values = np.arange(n), [None] * n
                start = batch.column(names.index("__init"))[at].as_py()
            last = keys[batch.num_rows - 1].as_py()
            took = np.full(n, -1)
            for i in range(at, batch.num_rows):
                took[tables.accepted[codes[i]][exits]] = i
                exits = tables.next[codes[i]][exits]
            for s in np.flatnonzero(took >= 0).tolist():
                values[s] = {g: batch.column(names.index(f"chg_{g}"))[int(took[s])].as_py() for g in given}
            kinds = {g: batch.column(names.index(f"chg_{g}")).type for g in given}
            key_type = keys.type
        if last is not None or exits is not None:
            struct = pa.struct([pa.field(g, kinds[g]) for g in given])
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([last], key_type), pa.array([start], pa.int32()),
                 pa.array([exits.tolist()], pa.list_(pa.int32())), pa.array([values], pa.list_(struct))],
                names=["__pid", key, "__init", "exits", "values"])
    return fn


def _entries(key: str):
    """Folds the compositions of one key: what the next partition after each of them starts from."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__pid")
        state, held, out = int(pdf["__init"].iloc[0]), None, []
        for r in pdf.to_dict("records"):
            held = r["values"][state] if r["values"][state] is not None else held
            state = int(r["exits"][state])
            if not pd.isna(r["__next"]):
                out.append({"__cp": int(r["__next"]), "__ck": r[key], "__cstate": state, "__cval": held})
        return pd.DataFrame(out, columns=["__cp", "__ck", "__cstate", "__cval"])
    return fn


def _apply(key: str, given: list[str], tables: _Tables, names_out: list[str]):
    """Arrow pass: every change with the state before it, the values of the accepted change before it,
    its reason and stamps."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, held = None, 0, None  # held: values of the key's last accepted change, one-row arrays
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            start = _starts([col[key]], n)
            start[0] = last is None or col[key][0].as_py() != last[0]
            last = (col[key][n - 1].as_py(),)
            rows, init, carried = (col[c].to_pylist() for c in ("__row", "__init", "__cstate"))
            has = np.asarray(col["__cval"].is_valid())
            # places in [held, carried values of every row, changes of the batch]
            before, at, reason, stamps = [], [], [], []
            place = 0 if held is not None else None
            for i in range(n):
                if start[i]:
                    state = init[i] if carried[i] is None else carried[i]
                    place = 1 + i if has[i] else None
                before.append(state)
                at.append(place)
                row = rows[i]
                reason.append(tables.reason[row][state])
                stamps.append(int(tables.stamps[row, state]))
                if tables.accepted[row, state]:
                    place = 1 + n + i
                state = int(tables.next[row, state])
            take = pa.array(at, pa.int64())
            out = [col[c] for c in names_out]
            out += [pa.array(before, pa.int32()), pa.array([p is not None for p in at], pa.bool_()), pa.array(reason, pa.string()), pa.array(stamps, pa.int32())]
            after = {}
            for g in given:
                kind = col[f"chg_{g}"].type
                first = held[g] if held is not None else pa.nulls(1, kind)
                carry = pc.struct_field(col["__cval"], g).cast(kind)
                pool = pa.concat_arrays([first, carry, col[f"chg_{g}"]])
                out.append(pool.take(take))
                after[g] = pool.take(pa.array([place], pa.int64()))
            held = after if place is not None else None
            yield pa.RecordBatch.from_arrays(out, names=[*names_out, "__state", "__chained", "reason", "__stamps", *[f"__prev_{g}" for g in given]])
    return fn


def apply_in_turn(current: DataFrame, changes: DataFrame, key: str, order: Iterable[str], rules: Rules, now,
                  extra: str | None = None, mode: str = "quarantine", num_partitions: int | None = None):
    """Applies all ``changes`` (``key``, the columns they give, ``order``) of every row of ``current``.

    Changes of a key go by ``order``, then by all they give, so that ties are equal changes. A rejected
    change leaves the row as it was, and the next one is judged against that. Changes of unknown or
    NULL keys change nothing; a column that ``changes`` lacks is unchanged, a NULL that they give is
    a NULL. ``extra``: the column whose presence in the new row the rules ask for.

    Returns ``(snapshot, decisions, rejected)``: decisions has a row per change with the row before it
    (``old_*``), the row it asks for (``new_*``), the order columns and ``reason`` (NULL = applied).
    """
    now, order = _lit_ts(now), list(order)
    for s in rules.stamps:
        if s not in current.columns:
            current = current.withColumn(s, F.lit(None).cast("timestamp_ntz"))
    given = [c for c in changes.columns if c != key and c not in order]
    tables = _tables(rules)
    old = current.select(*[F.col(c).alias(f"old_{c}") for c in current.columns])
    kinds = {c: current.schema[c].dataType for c in given}
    chg = changes.select(F.col(key).alias("__key"), *[F.col(c).cast(kinds[c]).alias(f"chg_{c}") for c in given], *[F.col(c).alias(f"ord_{c}") for c in order])
    j = old.join(chg, F.col(f"old_{key}") == F.col("__key")).drop("__key")
    row = _status_code(F.col("chg_status"), rules)
    named = (F.col(f"chg_{extra}") if extra in given else F.col(f"old_{extra}")).isNotNull() if extra else F.lit(False)
    row = row * 2 + named.cast("int")
    for s in rules.stamps:
        row = row * 3 + (F.when(F.col(f"chg_{s}").isNull(), CLEAR).otherwise(GIVE) if s in given else F.lit(KEEP))
    j = j.withColumn("__row", row.cast("int")).withColumn("__init", _state_code(rules, F.col("old_status"), [F.col(f"old_{s}") for s in rules.stamps]))
    okey = f"old_{key}"
    sort = [okey, *[f"ord_{c}" for c in order], *[f"chg_{c}" for c in given]]
    ranged = ranged_checkpoint(j, sort, num_partitions)
    value = T.StructType([T.StructField(g, kinds[g]) for g in given])
    kfield = j.schema[okey]
    last = ranged.mapInArrow(_last_compositions(okey, given, tables), T.StructType(
        [T.StructField("__pid", T.IntegerType()), kfield, T.StructField("__init", T.IntegerType()),
         T.StructField("exits", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(value))]))
    last = last.withColumn("__next", F.lead("__pid").over(Window.orderBy("__pid")))  # one row per partition
    carry = last.groupBy(okey).applyInPandas(_entries(okey), T.StructType(
        [T.StructField("__cp", T.IntegerType()), T.StructField("__ck", kfield.dataType), T.StructField("__cstate", T.IntegerType()), T.StructField("__cval", value)]))
    tagged = ranged.withColumn("__pid", F.spark_partition_id()).join(
        F.broadcast(carry), (F.col("__pid") == F.col("__cp")) & (F.col(okey) == F.col("__ck")), "left").drop("__pid", "__cp", "__ck")
    tagged = tagged.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in sort]).withColumn("__pos", F.monotonically_increasing_id())
    kept = [c for c in tagged.columns if c not in ("__row", "__init", "__cstate", "__cval")]
    schema = T.StructType([*[tagged.schema[c] for c in kept], T.StructField("__state", T.IntegerType()), T.StructField("__chained", T.BooleanType()),
                           T.StructField("reason", T.StringType()), T.StructField("__stamps", T.IntegerType()), *[T.StructField(f"__prev_{g}", kinds[g]) for g in given]])
    done = tagged.mapInArrow(_apply(okey, given, tables, kept), schema)
    # the row before a change: what the accepted changes have given, and the stamps they have set
    k = len(rules.stamps)
    before, after = {}, {}
    for c in current.columns:
        stored = F.col(f"old_{c}")
        before[c] = F.when(F.col("__chained"), F.col(f"__prev_{c}")).otherwise(stored) if c in given else stored
        if c in rules.stamps:
            bit = F.shiftright("__state", k - 1 - rules.stamps.index(c)).bitwiseAND(1) == 1
            before[c] = F.coalesce(before[c], F.when(F.col("__chained") & bit, now))
        after[c] = F.col(f"chg_{c}") if c in given else before[c]
        if c in rules.stamps:
            stamp = F.shiftright("__stamps", rules.stamps.index(c)).bitwiseAND(1) == 1
            after[c] = F.when(stamp, now).otherwise(after[c])
    decided = done.select(*[before[c].alias(f"old_{c}") for c in current.columns], *[after[c].alias(f"new_{c}") for c in current.columns],
                          *[F.col(f"ord_{c}").alias(c) for c in order], "reason", "__pos")
    decisions = decided.drop("__pos")
    rejected = decisions.filter(F.col("reason").isNotNull())
    _fail_if_any(rejected, mode)
    new = F.struct("__pos", *[F.col(f"new_{c}") for c in current.columns])
    final = decided.filter(F.col("reason").isNull()).groupBy(okey).agg(F.max(new).alias("__new")).withColumnRenamed(okey, "__key")
    snapshot = current.join(final, F.col(key) == F.col("__key"), "left").select(
        *[F.when(F.col("__new").isNotNull(), F.col(f"__new.new_{c}")).otherwise(F.col(c)).alias(c) for c in current.columns])
    return snapshot, decisions, rejected


def apply_game_changes(games: DataFrame, changes: DataFrame, now, order: Iterable[str], mode: str = "quarantine", num_partitions: int | None = None):
    """J1 with any number of changes per game, applied in turn (see :func:`apply_in_turn`)."""
    return apply_in_turn(games, changes, "game_id", order, GAME, now, None, mode, num_partitions)


def apply_question_reviews(questions: DataFrame, changes: DataFrame, now, order: Iterable[str], mode: str = "quarantine", num_partitions: int | None = None):
    """J2 with any number of reviews per question, applied in turn (see :func:`apply_in_turn`)."""
    return apply_in_turn(questions, changes, "question_id", order, REVIEW, now, "checked_by_adminid", mode, num_partitions)
