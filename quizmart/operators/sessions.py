"""
D10, E4, E6, G3).

Everything that is ordered per user, per lobby or globally goes through the skew-proof scan of
:mod:`quizmart.operators.scan`; "the matching earlier/later event" is then found with an equi join
on a unique (key, index) pair instead of a range join, so a user or lobby that holds a third of
all events is still spread over many tasks and never compared pairwise.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmart.operators.changes import first_per_key
from quizmart.operators.quality import assign_surrogate_key
from quizmart.operators.scan import _num_partitions, _starts, ranged_checkpoint, running_sum, sequence_number
from quizmart.session import checkpoint_root

# Kinds of the event feed
CONNECT, DISCONNECT, JOIN, REQUEST, CHAT = "connect", "disconnect", "join-chat", "requestJoin", "chat-message"

# Login texts of the reference
MSG_LOGIN_FILL_ALL = "Bitte alle Felder ausfüllen."
MSG_LOGIN_INVALID = "Ungültige Anmeldedaten"
ADMIN_USERNAME = "admin"


# ---------------------------------------------------------------------------- F3, E4
def coin_sessions(events: DataFrame, is_reset: Column, user: str = "user_id",
                  order: Iterable[str] = ("ts", "event_id")) -> DataFrame:
    """``session_id`` = number of resets so far for the user (a reset starts a new session;
    events before the first reset are session 0)."""
    return running_sum(events, [user], list(order), F.when(is_reset, 1).otherwise(0), "session_id")


def coin_totals(sessions: DataFrame, is_answer: Column, question: Column, right: Column,
                user: str = "user_id") -> DataFrame:
    """Coins per (user, session) = distinct questions answered right in the session (the
    page awards a coin once per question until the next reset)."""
    coin_q = F.when(is_answer & F.coalesce(right, F.lit(False)), question)
    return sessions.groupBy(user, "session_id").agg(F.count_distinct(coin_q).alias("coins"))


# ---------------------------------------------------------------------------- F4, F7, D7
def _presence_runs(events: DataFrame, socket: str, order: list[str]) -> DataFrame:
    """Every event with ``run`` = number of the socket's disconnects so far (incl. itself)."""
    return running_sum(events, [socket], order, F.when(F.col("kind") == DISCONNECT, 1).otherwise(0), "run")


def _openings(runs: DataFrame, socket: str, connect: str) -> DataFrame:
    """First connect of each run (the connect that opens the socket): one aggregate per run."""
    c = runs.filter(F.col("kind") == connect)
    return c.groupBy(socket, "run").agg(F.min(F.struct("ts", "event_id")).alias("o")).select(
        socket, "run", F.col("o.ts").alias("open_ts"), F.col("o.event_id").alias("open_event_id"))


def presence_intervals(events: DataFrame, socket: str = "user_id", connect: str = CONNECT) -> DataFrame:
    """connected intervals per socket — from the connect that opens it to the next disconnect
    (``end_ts`` NULL when still open). A repeated connect while open opens nothing; a disconnect
    while closed closes nothing. ``connect`` names the kind that opens a socket.

    The k-th run of a socket (after its k-th disconnect) opens at its first connect and is closed
    by disconnect number k+1: an equi join on (socket, k + 1).
    """
    order = ["ts", "event_id"]
    runs = _presence_runs(events.filter(F.col("kind").isin(connect, DISCONNECT)), socket, order)
    opens = _openings(runs, socket, connect)
    closes = runs.filter(F.col("kind") == DISCONNECT).select(
        F.col(socket).alias("__s"), (F.col("run") - 1).alias("__r"),
        F.col("ts").alias("close_ts"), F.col("event_id").alias("close_event_id"))
    j = opens.join(closes, (opens[socket] == closes["__s"]) & (opens["run"] == closes["__r"]), "left")
    return j.select(socket, "run", "open_ts", "open_event_id", "close_ts", "close_event_id")


def _presence_pass(socket: str, connect: str):
    """Arrow pass over (socket, ts, event_id)-sorted rows: per-socket open/closed state machine.
    Only socket, kind and carry are looked at; the other columns go through as they are."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, 0  # socket of the last row seen, open after it
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.schema.names
            sock, kind = batch.column(names.index(socket)), batch.column(names.index("kind"))
            carry = np.asarray(pc.fill_null(batch.column(names.index("__carry")), 0)).astype("int64")
            start = _starts([sock], n)
            at = np.flatnonzero(start)
            enter = carry[at]  # state entering each socket's rows
            if last is not None and sock[0].as_py() == last[0]:
                enter[0] = state
            opens = np.asarray(pc.fill_null(pc.equal(kind, connect), False))
            closes = np.asarray(pc.fill_null(pc.equal(kind, DISCONNECT), False))
            length = np.diff(np.append(at, n))
            begin, enter = np.repeat(at, length), np.repeat(enter, length)
            event = np.maximum.accumulate(np.where(opens | closes, np.arange(n), -1))
            after = np.where(event >= begin, opens[np.maximum(event, 0)].astype("int64"), enter)
            before = np.where(np.arange(n) == begin, enter, np.roll(after, 1))
            last, state = (sock[n - 1].as_py(),), int(after[-1])
            kept = [i for i, x in enumerate(names) if x != "__carry"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array((after - before).astype("int32")), pa.array((after == 1) & ~closes)],
                names=[*[names[i] for i in kept], "delta", "sender_open"])
    return fn


def _presence_deltas(events: DataFrame, socket: str, connect: str) -> DataFrame:
    """Each event with ``delta`` (+1 opens the socket, -1 closes it, else 0) and ``sender_open``
    (the socket is open at this event).

    One ordered pass per socket with the skew-proof layout: range partitions by (socket, ts,
    event_id) in a checkpoint; a partition's first socket may continue from earlier partitions,
    and its entry state is the state after that socket's last presence event there — a
    per-(partition, socket) aggregate and a window over it, ≤ one carry row per partition."""
    order = ["ts", "event_id"]
    ranged = ranged_checkpoint(events, [socket] + order)
    pres = F.when(F.col("kind") == connect, 1).when(F.col("kind") == DISCONNECT, 0)
    last = (ranged.withColumn("__pid", F.spark_partition_id()).groupBy("__pid", socket)
            .agg(F.max_by(pres, F.when(pres.isNotNull(), F.struct(*order))).alias("__last")))
    w = Window.partitionBy(socket).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = (last.withColumn("__carry", F.last("__last", True).over(w)).filter(F.col("__carry").isNotNull())
             .select(F.col("__pid").alias("__cp"), F.col(socket).alias("__cs"), "__carry"))
    tagged = ranged.withColumn("__pid", F.spark_partition_id())
    j = tagged.join(F.broadcast(carry), (F.col("__pid") == F.col("__cp")) & (F.col(socket) == F.col("__cs")), "left")
    j = j.drop("__cp", "__cs").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in [socket] + order])
    schema = T.StructType(list(events.schema.fields) + [T.StructField("delta", T.IntegerType()),
                                                        T.StructField("sender_open", T.BooleanType())])
    return j.select(*events.columns, "__carry").mapInArrow(_presence_pass(socket, connect), schema)


def concurrency_timeline(events: DataFrame, socket: str = "user_id", connect: str = CONNECT) -> DataFrame:
    """connected sockets after each event (``clientsCount``) — a global running sum of
    open/close deltas, computed as a two-phase scan over range partitions (no single-partition
    window)."""
    d = _presence_deltas(events, socket, connect)
    return running_sum(d, [], ["ts", "event_id"], F.col("delta"), "connected").drop("delta", "sender_open")


def chat_recipients(events: DataFrame, socket: str = "user_id", connect: str = CONNECT) -> DataFrame:
    """D7 (count form): each chat message reaches every connection open at send time except the
    sender's own (broadcast to all sockets, not to the group). ``recipients`` = connected count
    at the message minus the sender's open connection."""
    d = _presence_deltas(events, socket, connect)
    t = running_sum(d, [], ["ts", "event_id"], F.col("delta"), "connected")
    m = t.filter(F.col("kind") == CHAT)
    return m.select("event_id", "ts", F.col(socket).alias("sender"), "connected",
                    (F.col("connected") - F.when(F.col("sender_open"), 1).otherwise(0)).alias("recipients"))


# ---------------------------------------------------------------------------- D10
def join_request_timeouts(requests: DataFrame, responses: DataFrame, limit: str,
                          user: str = "user_id") -> DataFrame:
    """Requests with no response of the same user within ``[ts, ts + limit]``.

    The first response at or after each request is found by counting responses in one ordered
    scan per user (responses sort after requests at equal time) and joining on (user, count + 1).
    """
    r = requests.select(user, "ts", "event_id", F.lit(0).alias("__resp"))
    s = responses.select(user, "ts", "event_id", F.lit(1).alias("__resp"))
    both = running_sum(r.unionByName(s), [user], ["ts", "__resp", "event_id"], F.col("__resp"), "__n")
    reqs = both.filter(F.col("__resp") == 0)
    resp = both.filter(F.col("__resp") == 1).select(F.col(user).alias("__u"), F.col("__n").alias("__k"),
                                                    F.col("ts").alias("response_ts"))
    j = reqs.join(resp, (reqs[user] == resp["__u"]) & ((reqs["__n"] + 1) == resp["__k"]), "left")
    late = F.col("response_ts").isNull() | (F.col("response_ts") > F.col("ts") + F.expr(f"INTERVAL {limit}"))
    return j.filter(late).select(user, F.col("ts").alias("request_ts"), "event_id", "response_ts")


# ---------------------------------------------------------------------------- F2, D6, G3
def first_registration_wins(requests: DataFrame, users: DataFrame, username: str = "username",
                            order: Iterable[str] = ("ts", "event_id")):
    """a username already taken is rejected; within the batch the earliest request wins;
    new ids continue after ``max(users.user_id)`` in request order. Case-sensitive.

    Returns ``(accepted_with_user_id, rejected_with_reason)``."""
    order = list(order)
    taken = users.select(username).distinct()
    fresh = requests.join(taken, username, "left_anti")
    rej_taken = requests.join(taken, username, "left_semi").withColumn("reason", F.lit("username_taken"))
    firsts, rest = first_per_key(fresh, [username], order)
    accepted = assign_surrogate_key(firsts, "user_id", order, existing=users, existing_key="user_id")
    rejected = rest.withColumn("reason", F.lit("duplicate_in_batch")).unionByName(rej_taken)
    return accepted, rejected


def login_outcomes(attempts: DataFrame, credentials: DataFrame) -> DataFrame:
    """Login attempts against stored (username, SHA-256 password hash) credentials.

    Empty (trimmed) username or password → "fill all fields"; exact match → success with
    ``is_admin = username = 'admin'``; else "invalid credentials"."""
    a = attempts.withColumn("__u", F.trim("username")).withColumn("__p", F.trim("password"))
    a = a.withColumn("__h", F.sha2(F.col("__p"), 256))
    c = credentials.select(F.col("username").alias("__cu"), F.col("password_hash").alias("__ch"))
    j = a.join(c, (F.col("__u") == F.col("__cu")) & (F.col("__h") == F.col("__ch")), "left")
    empty = (F.coalesce(F.col("__u"), F.lit("")) == "") | (F.coalesce(F.col("__p"), F.lit("")) == "")
    ok = ~empty & F.col("__cu").isNotNull()
    return (j.withColumn("success", ok)
            .withColumn("is_admin", ok & (F.col("__u") == ADMIN_USERNAME))
            .withColumn("message", F.when(empty, MSG_LOGIN_FILL_ALL).when(~ok, MSG_LOGIN_INVALID))
            .drop("__u", "__p", "__h", "__cu", "__ch"))


def take_first_n_per_key(df: DataFrame, keys: Iterable[str], order: Iterable[str], n: int) -> DataFrame:
    """The first ``n`` rows per key (FIFO ``splice(0, n)``).

    For small ``n`` a ``row_number() <= n`` filter, which Spark limits map-side (each task
    forwards at most ``n`` rows per key); for large ``n`` the skew-proof position scan."""
    keys, order = list(keys), list(order)
    if n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
        return df.withColumn("__pos", F.row_number().over(w)).filter(F.col("__pos") <= n).drop("__pos")
    return sequence_number(df, keys, order, "__pos").filter(F.col("__pos") <= n).drop("__pos")


# ---------------------------------------------------------------------------- F6, E6
EMIT_ROWS = 10_000  # rows of the second pass that are sent on together


def _fold_rows(sock, kind, ts, eid, lo, hi, waiter, allow_self, pairs):
    """The lobby's FIFO rule over rows [lo, hi): returns the waiter after them; appends pairs."""
    for i in range(lo, hi):
        s = sock[i]
        if kind[i] == REQUEST:
            if waiter is None:
                waiter = s
            elif waiter == s and not allow_self:
                pass  # the waiter queued again: nothing happens
            else:
                pairs.append((waiter, s, ts[i], eid[i]))
                waiter = None
        elif kind[i] == DISCONNECT and waiter == s:
            waiter = None
    return waiter


def _pieces(it: Iterator[pd.DataFrame], lobby: str):
    """The partition's rows as (lobby value, begins a piece, frame, lo, hi), batch by batch: a piece is a
    lobby's rows of the partition and may go on in later batches."""
    last = None
    for pdf in it:
        if pdf.empty:
            continue
        keys = [None if pd.isna(k) else k for k in pdf[lobby].tolist()]
        lo = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[lo]:
                yield keys[lo], last is None or last[0] != keys[lo], pdf, lo, i
                last = (keys[lo],)
                lo = i


class _Piece:
    """What a lobby's rows of one partition come to, row by row: from an empty queue (``a``) and from a
    waiter whom the piece's first request meets (``c``). Pairs are counted, not kept."""

    def __init__(self, key):
        self.key, self.first = key, None
        self.a = self.c = None
        self.a_n = self.c_n = 0

    def add(self, sock, kind, ts, eid, allow_self: bool) -> None:
        pairs: list = []
        self.a = _fold_rows(sock, kind, ts, eid, 0, len(sock), self.a, allow_self, pairs)
        self.a_n += len(pairs)
        lo = 0
        if self.first is None:
            lo = next((i for i in range(len(sock)) if kind[i] == REQUEST), None)
            if lo is None:
                return
            self.first = (sock[lo], ts[lo], eid[lo])
            self.c_n, lo = 1, lo + 1
        pairs = []
        self.c = _fold_rows(sock, kind, ts, eid, lo, len(sock), self.c, allow_self, pairs)
        self.c_n += len(pairs)

    def row(self, lobby: str, pid: int, is_first: bool) -> dict:
        s1, ts, eid = self.first or (None, None, None)
        return {lobby: self.key, "pid": pid, "is_first": is_first, "has_req": self.first is not None, "s1": s1,
                "r1_ts": ts, "r1_eid": eid, "a_out": self.a, "a_n": self.a_n, "c_out": self.c, "c_n": self.c_n}


def _slices(pdf: pd.DataFrame, socket: str, lo: int, hi: int) -> list[list]:
    return [pdf[c].iloc[lo:hi].tolist() for c in (socket, "kind", "ts", "event_id")]


def _summarize_lobbies(lobby: str, socket: str, allow_self: bool):
    def fn(it):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        first = last = None  # the partition's first and latest pieces
        for key, begins, pdf, lo, hi in _pieces(it, lobby):
            if begins:
                last = _Piece(key)
                first = first or last
            last.add(*_slices(pdf, socket, lo, hi), allow_self)
        rows = [p.row(lobby, pid, p is first) for p in ([first] if first is last else [first, last]) if p]
        if rows:
            yield pd.DataFrame(rows)
    return fn


def _none(x):
    return None if x is None or (not isinstance(x, (str, bytes)) and pd.isna(x)) else x


def _resolve_lobby(lobby: str, allow_self: bool):
    """Fold over one lobby's partition pieces (≤ partitions + 1 rows): incoming waiter, variant
    and pair offset of each piece."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        state, offset, out = None, 0, []
        for r in pdf.itertuples(index=False):
            incoming = state
            r = r._replace(a_out=_none(r.a_out), c_out=_none(r.c_out), s1=_none(r.s1),
                           cand_a=_none(r.cand_a), cand_c=_none(r.cand_c))
            if incoming is None:
                variant, n, state = "A", r.a_n, r.a_out
            else:
                member = bool(r.mem_a) if incoming == r.cand_a else bool(r.mem_c)
                if not r.has_req:
                    variant, n, state = "P", 0, (None if member else incoming)
                elif member or (incoming == r.s1 and not allow_self):
                    variant, n, state = "A", r.a_n, r.a_out
                else:
                    variant, n, state = "C", r.c_n, r.c_out
            out.append({lobby: getattr(r, lobby), "pid": r.pid, "incoming": incoming, "variant": variant,
                        "pair_offset": offset})
            offset += n
            state = _none(state)
        return pd.DataFrame(out, columns=[lobby, "pid", "incoming", "variant", "pair_offset"])
    return fn


def _emit_pairs(lobby: str, socket: str, allow_self: bool):
    """Second pass: fold every piece from its resolved entry waiter, batch by batch. Emits the pairs
    and, per piece, its end state (``row_kind = 'end'``, ``player1`` = the waiter left, if any)."""
    columns = [lobby, "row_kind", "pid", "group_no", "player1", "player2", "paired_at", "event_id"]

    def fn(it):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        here = waiter = None  # (lobby value,) of the piece, its waiter and its pairs so far
        offset, rows = 0, []

        def end():
            return {lobby: here[0], "row_kind": "end", "pid": pid, "group_no": None, "player1": waiter,
                    "player2": None, "paired_at": None, "event_id": None}

        for key, begins, pdf, lo, hi in _pieces(it, lobby):
            if begins:
                first = here is None
                if not first:
                    rows.append(end())
                here, waiter, offset = (key,), None, 0
                if first and not pd.isna(pdf.at[lo, "__offset"]):
                    offset, waiter = int(pdf.at[lo, "__offset"]), _none(pdf.at[lo, "__incoming"])
            sock, kind, ts, eid = _slices(pdf, socket, lo, hi)
            pairs: list = []
            waiter = _fold_rows(sock, kind, ts, eid, 0, len(sock), waiter, allow_self, pairs)
            rows += [{lobby: key, "row_kind": "pair", "pid": pid, "group_no": offset + k + 1, "player1": p1,
                      "player2": p2, "paired_at": t, "event_id": e} for k, (p1, p2, t, e) in enumerate(pairs)]
            offset += len(pairs)
            if len(rows) >= EMIT_ROWS:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if here is not None:
            rows.append(end())
            yield pd.DataFrame(rows, columns=columns)
    return fn


def lobby_fold(events: DataFrame, lobby: str = "lobby", socket: str = "user_id",
               allow_self_pair: bool = False, num_partitions: int | None = None) -> DataFrame:
    """The FIFO lobby rule folded over every lobby's events in (ts, event_id) order.

    Distributed fold: events are range-partitioned by (lobby, ts, event_id) and checkpointed; each
    partition folds its rows and summarises its first and last lobby piece under the only two
    possible entry states (empty queue, or some waiter who is paired by the piece's first
    request); membership of the actual candidate waiters among the piece's early disconnects is
    checked with a join; a per-lobby fold over the ≤ P+1 piece summaries fixes each piece's entry
    state and pair offset; a second pass folds each piece from its entry state and emits the
    pairs (``row_kind = 'pair'``) and every piece's end state (``row_kind = 'end'``).
    """
    spark = events.sparkSession
    checkpoint_root(spark)
    n = _num_partitions(events, num_partitions)
    order = [lobby, "ts", "event_id"]
    ev = events.filter(F.col("kind").isin(REQUEST, DISCONNECT)).select(lobby, "ts", "event_id", socket, "kind")
    ranged = (ev.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order])
              .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
              .checkpoint(eager=True))
    lt = ev.schema[lobby].dataType
    st = ev.schema[socket].dataType
    tt = ev.schema["ts"].dataType
    sschema = T.StructType([T.StructField(lobby, lt), T.StructField("pid", T.IntegerType()),
                            T.StructField("is_first", T.BooleanType()), T.StructField("has_req", T.BooleanType()),
                            T.StructField("s1", st), T.StructField("r1_ts", tt), T.StructField("r1_eid", T.LongType()),
                            T.StructField("a_out", st), T.StructField("a_n", T.LongType()),
                            T.StructField("c_out", st), T.StructField("c_n", T.LongType())])
    summ = ranged.mapInPandas(_summarize_lobbies(lobby, socket, allow_self_pair), sschema)
    # One row per (lobby, pid): a single-lobby partition reports one piece that is first and last.
    summ = summ.groupBy(lobby, "pid").agg(*[F.first(c).alias(c) for c in
                                            ["has_req", "s1", "r1_ts", "r1_eid", "a_out", "a_n", "c_out", "c_n"]],
                                          F.max(F.col("is_first").cast("int")).alias("is_first"))
    # Candidate entry waiters: the outcomes of the lobby's last earlier piece that had a request.
    w = Window.partitionBy(lobby).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # (a struct, so a request piece whose outcome is an empty queue is not skipped as NULL)
    cand = F.last(F.when(F.col("has_req"), F.struct(F.col("a_out").alias("a"), F.col("c_out").alias("c"))),
                  True).over(w)
    summ = summ.withColumn("__cand", cand).withColumn("cand_a", F.col("__cand.a")) \
        .withColumn("cand_c", F.col("__cand.c")).drop("__cand")
    summ = summ.checkpoint(eager=True)  # ≤ 2 rows per partition, read twice below
    # Disconnects before a piece's first request (anywhere if it has none) of candidate waiters.
    firsts = F.broadcast(summ.filter(F.col("is_first") == 1).select(
        F.col(lobby).alias("__l"), F.col("pid").alias("__p"), "has_req", "r1_ts", "r1_eid", "cand_a", "cand_c"))
    disc = ranged.filter(F.col("kind") == DISCONNECT).withColumn("__pid", F.spark_partition_id())
    dj = disc.join(firsts, disc[lobby].eqNullSafe(firsts["__l"]) & (disc["__pid"] == firsts["__p"]))
    early = dj.filter(~F.col("has_req") | (F.struct("ts", "event_id") < F.struct("r1_ts", "r1_eid")))
    mem = early.groupBy("__l", "__p").agg(
        F.max((F.col(socket) == F.col("cand_a")).cast("int")).alias("mem_a"),
        F.max((F.col(socket) == F.col("cand_c")).cast("int")).alias("mem_c"))
    full = (summ.join(mem, summ[lobby].eqNullSafe(mem["__l"]) & (summ["pid"] == mem["__p"]), "left").drop("__l", "__p")
            .fillna(0, subset=["mem_a", "mem_c"]))
    rschema = T.StructType([T.StructField(lobby, lt), T.StructField("pid", T.IntegerType()),
                            T.StructField("incoming", st), T.StructField("variant", T.StringType()),
                            T.StructField("pair_offset", T.LongType())])
    res = full.groupBy(lobby).applyInPandas(_resolve_lobby(lobby, allow_self_pair), rschema)
    res = res.select(F.col(lobby).alias("__l"), F.col("pid").alias("__p"), F.col("incoming").alias("__incoming"),
                     F.col("variant").alias("__variant"), F.col("pair_offset").alias("__offset"))
    tagged = ranged.withColumn("__pid", F.spark_partition_id())
    tagged = tagged.join(F.broadcast(res), tagged[lobby].eqNullSafe(res["__l"]) & (tagged["__pid"] == res["__p"]), "left")
    tagged = tagged.drop("__l", "__p").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    oschema = T.StructType([T.StructField(lobby, lt), T.StructField("row_kind", T.StringType()),
                            T.StructField("pid", T.IntegerType()), T.StructField("group_no", T.LongType()),
                            T.StructField("player1", st), T.StructField("player2", st),
                            T.StructField("paired_at", tt), T.StructField("event_id", T.LongType())])
    return tagged.mapInPandas(_emit_pairs(lobby, socket, allow_self_pair), oschema)


def lobby_pairs(events: DataFrame, lobby: str = "lobby", socket: str = "user_id",
                allow_self_pair: bool = False, num_partitions: int | None = None) -> DataFrame:
    """FIFO lobby pairing (server rule: a request waits; the next request pairs with the
    waiter; a disconnect of the waiter empties the queue). Groups are always 2 players; the
    group number is a stable sequence per lobby. With ``allow_self_pair=False`` a second request
    of the waiter is ignored. Output: (lobby, group_no, player1, player2, paired_at, event_id).

    Computed by :func:`lobby_fold` (distributed fold, no lobby collected into one task)."""
    f = lobby_fold(events, lobby, socket, allow_self_pair, num_partitions)
    return f.filter(F.col("row_kind") == "pair").select(lobby, "group_no", "player1", "player2",
                                                        "paired_at", "event_id")


def lobby_waiting(events: DataFrame, lobby: str = "lobby", socket: str = "user_id",
                  allow_self_pair: bool = False, num_partitions: int | None = None) -> DataFrame:
    """The player left waiting in each lobby after its last event (NULL: empty queue)."""
    f = lobby_fold(events, lobby, socket, allow_self_pair, num_partitions).filter(F.col("row_kind") == "end")
    return f.groupBy(lobby).agg(F.max_by("player1", "pid").alias("waiting_player"))


def lobby_status(events: DataFrame, lobby: str = "lobby", socket: str = "user_id", connect: str = CONNECT) -> DataFrame:
    """Per lobby after its last event — players waiting (0/1), groups formed, groups still
    active (a group is dropped once both players have disconnected after it formed), and sockets
    connected.

    "Disconnected after the group formed" compares with each player's last disconnect time (one
    row per player), not with every disconnect."""
    t = concurrency_timeline(events, socket, connect)
    last = t.groupBy(lobby).agg(F.max_by("connected", F.struct("ts", "event_id")).alias("connected_end"))
    fold = lobby_fold(events, lobby, socket).checkpoint(eager=True)  # read for the pairs and for the ends
    pairs = fold.filter(F.col("row_kind") == "pair")
    disc = events.filter(F.col("kind") == DISCONNECT).groupBy(socket).agg(F.max("ts").alias("last_disc"))
    d1 = disc.select(F.col(socket).alias("__p1"), F.col("last_disc").alias("__d1"))
    d2 = disc.select(F.col(socket).alias("__p2"), F.col("last_disc").alias("__d2"))
    p = pairs.join(d1, pairs["player1"] == d1["__p1"], "left").join(d2, pairs["player2"] == d2["__p2"], "left")
    gone = F.coalesce(F.col("__d1") > F.col("paired_at"), F.lit(False)) & F.coalesce(
        F.col("__d2") > F.col("paired_at"), F.lit(False))
    g = p.groupBy(lobby).agg(F.count(F.lit(1)).alias("groups_formed"), F.count_if(~gone).alias("active_groups"))
    w = fold.filter(F.col("row_kind") == "end").groupBy(lobby).agg(F.max_by("player1", "pid").alias("waiting_player"))
    return (last.join(w, lobby, "left").join(g, lobby, "left")
            .select(lobby, F.when(F.col("waiting_player").isNotNull(), 1).otherwise(0).alias("waiting"),
                    F.coalesce("groups_formed", F.lit(0)).cast("bigint").alias("groups_formed"),
                    F.coalesce("active_groups", F.lit(0)).cast("bigint").alias("active_groups"),
                    "connected_end"))


chat_fanout = chat_recipients
