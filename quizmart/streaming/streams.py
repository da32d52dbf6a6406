"""

Each job reads a stream (``readStream``), runs the same library operator as its batch twin and
writes to a sink that is safe to re-run:

* ``foreachBatch`` jobs (K1, K5, K7) write every micro-batch into its own ``batch_id=N`` folder
  with overwrite, so a replayed batch replaces its own output (exactly-once at the sink);
* K2 is a streaming aggregate (state store), K3/K4 keep per-key state with
  ``applyInPandasWithState`` (one waiter per lobby / the open sockets of a bucket of sockets);
* K6 is a stream-stream left outer join with watermarks on both sides.

Checkpoints live under the shared ``spark.checkpoint.dir``. ``run_available_now`` drives a query
to completion (``trigger(availableNow=True)``) — how the tests and the registered queries run them.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from quizmart.operators import changes, reports
from quizmart.operators.sessions import CHAT, CONNECT, DISCONNECT, JOIN, REQUEST, _fold_rows, join_request_timeouts
from quizmart.session import scratch_path


def read_stream_table(spark: SparkSession, folder: str, name: str, max_files_per_trigger: int | None = None,
                      schema: T.StructType | None = None) -> DataFrame:
    """A table of Parquet files as a stream: ``<folder>/<name>.parquet`` (file or directory)."""
    folder = folder.rstrip("/")
    schema = schema or spark.read.parquet(f"{folder}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def run_available_now(writer, name: str, spark: SparkSession, path: str | None = None):
    """Start ``writer`` (a DataStreamWriter) with an availableNow trigger and a fresh checkpoint
    under the shared folder; block until all available input is processed. State lives in RocksDB
    with changelog checkpoints, so it may outgrow the heap and a trigger uploads its changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    w = writer.option("checkpointLocation", scratch_path(spark, f"ckpt-{name}")).trigger(availableNow=True)
    q = w.start(path) if path else w.start()
    q.awaitTermination()
    return q


def _batch_dir(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch_id={batch_id}"


def _read_previous(spark: SparkSession, root: str, batch_id: int) -> DataFrame | None:
    """Sink rows of earlier batches (a replayed batch never sees its own earlier attempt)."""
    if batch_id == 0:
        return None
    try:
        df = spark.read.parquet(root)
    except AnalysisException as e:  # no batch has written rows yet; any other failure is an error
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return df.filter(F.col("batch_id") < batch_id).drop("batch_id")


# ---------------------------------------------------------------------------- K1
def stream_answers(stream: DataFrame, answers: DataFrame, sink: str, quarantine: str,
                   keys: Iterable[str] = ("game_id", "user_id", "round_no"),
                   order: Iterable[str] = ("answered_at",)):
    """K1: score each answer against the answer table (stream-static lookup, D5) and keep the
    first answer per (game, user, round) — first within the micro-batch by ``order``, and never
    after a key already in the sink (F5 against earlier batches). Returns a DataStreamWriter."""
    keys, order = list(keys), list(order)

    def each(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        existing = _read_previous(spark, sink, batch_id)
        # read for the stored keys and for the decisions, which are written to two places: both are
        # kept for the duration of this batch
        scored = changes.score_all(batch, answers).persist()
        dec = changes.round_answer_decisions(scored, existing, keys=keys, order=order, scored=True,
                                             prune_existing=True).persist()
        try:
            dec.filter(F.col("reason").isNull()).drop("reason").write.mode("overwrite").parquet(
                _batch_dir(sink, batch_id))
            dec.filter(F.col("reason").isNotNull()).write.mode("overwrite").parquet(_batch_dir(quarantine, batch_id))
        finally:
            dec.unpersist()
            scored.unpersist()

    return stream.writeStream.foreachBatch(each)


# ---------------------------------------------------------------------------- K2
def stream_scores(stream: DataFrame, games: DataFrame, points_per_right: int = 10) -> DataFrame:
    """K2: running score per user (E3) as a streaming aggregate (state store keyed by user);
    write it with :func:`write_updates` (``update`` mode: only changed users per trigger)."""
    j = stream.join(games.select("game_id"), "game_id")  # stream-static inner join: unknown games drop
    return j.groupBy("user_id").agg(
        F.coalesce(F.sum(reports.points(F.col("right_wrong"), points_per_right)), F.lit(0)).cast("bigint")
        .alias("score"))


def write_updates(agg: DataFrame, path: str):
    """Sink for a streaming aggregate in ``update`` mode: each trigger writes only the keys it
    changed into its own ``batch_id=N`` folder (overwrite, so a replay is idempotent)."""
    return agg.writeStream.outputMode("update").foreachBatch(
        lambda b, batch_id: b.write.mode("overwrite").parquet(_batch_dir(path, batch_id)))


def latest_values(path: str, spark: SparkSession, keys: list[str]) -> DataFrame:
    """Current value per key of an update log written by :func:`write_updates`."""
    log = spark.read.parquet(path)
    vals = [c for c in log.columns if c not in keys and c != "batch_id"]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*vals), "batch_id").alias("__v"))
    return last.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in vals])


# ---------------------------------------------------------------------------- K3
PAIR_SCHEMA = T.StructType([T.StructField("lobby", T.StringType()), T.StructField("group_no", T.LongType()),
                            T.StructField("player1", T.LongType()), T.StructField("player2", T.LongType()),
                            T.StructField("paired_at", T.TimestampType()), T.StructField("event_id", T.LongType())])
LOBBY_STATE = T.StructType([T.StructField("waiter", T.LongType()), T.StructField("groups", T.LongType())])


def _lobby_step(allow_self: bool):
    def fn(key, batches: Iterator[pd.DataFrame], state):
        waiter, groups = (state.get if state.exists else (None, 0))
        waiter = None if waiter is None or pd.isna(waiter) else int(waiter)
        # One lobby's rows of this micro-batch (bounded by the trigger size), in event order.
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], kind="stable", ignore_index=True)
        pairs: list = []
        waiter = _fold_rows(pdf["user_id"].tolist(), pdf["kind"].tolist(), pdf["ts"].tolist(),
                            pdf["event_id"].tolist(), 0, len(pdf), waiter, allow_self, pairs)
        state.update((waiter, int(groups) + len(pairs)))
        rows = [{"lobby": key[0], "group_no": int(groups) + i + 1, "player1": p1, "player2": p2,
                 "paired_at": t, "event_id": e} for i, (p1, p2, t, e) in enumerate(pairs)]
        yield pd.DataFrame(rows, columns=[f.name for f in PAIR_SCHEMA.fields])
    return fn


def stream_lobby(stream: DataFrame, lobby: str = "lobby", allow_self_pair: bool = False) -> DataFrame:
    """K3: FIFO lobby pairing (F6) with keyed state per lobby: the state is the waiting player (at
    most one, since a group forms as soon as two wait) and the number of groups formed."""
    ev = stream.filter(F.col("kind").isin(REQUEST, DISCONNECT)).select(
        F.col(lobby).alias("lobby"), "ts", "event_id", "user_id", "kind")
    return ev.groupBy("lobby").applyInPandasWithState(
        _lobby_step(allow_self_pair), PAIR_SCHEMA, LOBBY_STATE, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------------------- K4
PRESENCE_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
                                T.StructField("user_id", T.LongType()), T.StructField("kind", T.StringType()),
                                T.StructField("delta", T.IntegerType()), T.StructField("notice", T.StringType())])
#: The sockets of a bucket that are open, and those that have joined.
PRESENCE_STATE = T.StructType([T.StructField("open", T.ArrayType(T.LongType())), T.StructField("joined", T.ArrayType(T.LongType()))])

#: Keyed state is held, and Python is called, for buckets of sockets and not for each socket: a call costs
#: the same for one row as for thousands. More buckets make a bucket's rows and state smaller.
STATE_BUCKETS = 1024
#: Stands for a NULL id in the state functions, after all others as in their order.
NO_ID = (1 << 63) - 1


def bucket_of(socket: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(socket), F.lit(buckets))


def id_or(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID)).alias(column)


def id_of(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID)).alias(column)


def _last_of(marked: np.ndarray, begin: np.ndarray, value: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """``value`` at the latest ``marked`` row up to each row, itself included, since its group's ``begin``;
    ``enter`` where there is none."""
    at = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
    return np.where(at >= begin, value[np.maximum(at, 0)], enter)


def _presence_step(connect: str, join: str):
    def fn(key, batches: Iterator[pd.DataFrame], state):
        was_open, had_joined = (np.array(x, "int64") for x in state.get) if state.exists else (np.empty(0, "int64"),) * 2
        # a bucket's rows of this micro-batch, each socket's in event order
        pdf = pd.concat(list(batches), ignore_index=True)
        ts = pdf["ts"].to_numpy("datetime64[ns]")
        late = np.where(np.isnat(ts), np.iinfo("int64").max, ts.astype("int64"))
        pdf = pdf.iloc[np.lexsort((pdf["event_id"].to_numpy(), late, pdf["user_id"].to_numpy()))]
        user, kind, n = pdf["user_id"].to_numpy(), pdf["kind"].to_numpy(), len(pdf)
        connects, closes, joins = kind == connect, kind == DISCONNECT, kind == join
        first = np.append(True, user[1:] != user[:-1])
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, n))
        begin = np.repeat(at, length)
        enter = [np.repeat(np.isin(user[at], x), length) for x in (was_open, had_joined)]
        now_open = _last_of(connects | closes, begin, connects, enter[0])
        now_joined = _last_of(joins | closes, begin, joins, enter[1])
        is_open, joined = (np.where(first, e, np.append(False, x[:-1])) for e, x in zip(enter, (now_open, now_joined), strict=True))
        last = at + length - 1
        left = [np.append(x[~np.isin(x, user[at])], user[at][y[last]]) for x, y in ((was_open, now_open), (had_joined, now_joined))]
        if len(left[0]) or len(left[1]):
            state.update(tuple(x.tolist() for x in left))
        elif state.exists:  # closed sockets need no state
            state.remove()
        out = pdf[["event_id", "ts", "user_id", "kind"]].reset_index(drop=True)
        out["delta"] = ((connects & ~is_open).astype("int32") - (closes & ~connects & is_open)).astype("int32")
        out["notice"] = np.where(joins, "player-joined", np.where(closes & joined, "player-left", None))
        yield out
    return fn


def stream_presence(stream: DataFrame, connect: str = CONNECT, join: str = JOIN, buckets: int = STATE_BUCKETS) -> DataFrame:
    """K4: per-socket state → one row per connect, join and disconnect event with its gauge ``delta``
    (+1 opens, -1 closes, 0 repeats) and its notice: joined at a ``join`` event, left at a
    disconnect of a socket that had joined. The connected gauge is the running sum of ``delta`` (F7).
    The state is held in ``buckets`` of sockets (see :data:`STATE_BUCKETS`)."""
    ev = stream.filter(F.col("kind").isin(connect, join, DISCONNECT)).select(id_or("event_id"), "ts", id_or("user_id"), "kind")
    out = ev.withColumn("bucket", bucket_of(F.col("user_id"), buckets)).groupBy("bucket").applyInPandasWithState(
        _presence_step(connect, join), PRESENCE_SCHEMA, PRESENCE_STATE, "append", GroupStateTimeout.NoTimeout)
    return out.select(id_of("event_id"), "ts", id_of("user_id"), "kind", "delta", "notice")


# ---------------------------------------------------------------------------- K5
def stream_chat(stream: DataFrame, users: DataFrame, kind: str = CHAT) -> DataFrame:
    """K5: chat messages with the sender's name, time and (where the feed has it) text
    (stream-static join), ready to append to ``chats``; the recipients per message are D7 on the
    batch table."""
    text = ["text"] if "text" in stream.columns else []
    m = stream.filter(F.col("kind") == kind).select("event_id", "ts", "user_id", *text)
    return m.join(users.select("user_id", "username"), "user_id", "inner")


# ---------------------------------------------------------------------------- K6
def stream_join_timeouts(requests: DataFrame, responses: DataFrame, limit: str, watermark: str) -> DataFrame:
    """K6: requests without a response of the same user within ``limit`` (D10 on streams).

    Stream-stream left outer join with watermarks on both sides; a request is emitted as timed
    out once the watermark passes its window. A run that ends with its input leaves the last
    requests pending; :func:`flush_join_timeouts` gives those."""
    r = requests.select(F.col("user_id").alias("r_user"), F.col("ts").alias("request_ts"), "event_id") \
        .withWatermark("request_ts", watermark)
    s = responses.select(F.col("user_id").alias("s_user"), F.col("ts").alias("response_ts")) \
        .withWatermark("response_ts", watermark)
    cond = ((F.col("r_user") == F.col("s_user")) & (F.col("response_ts") >= F.col("request_ts"))
            & (F.col("response_ts") <= F.col("request_ts") + F.expr(f"INTERVAL {limit}")))
    j = r.join(s, cond, "leftOuter")
    return j.filter(F.col("response_ts").isNull()).select(F.col("r_user").alias("user_id"), "request_ts", "event_id")


def flush_join_timeouts(requests: DataFrame, responses: DataFrame, emitted: DataFrame, limit: str,
                        watermark: str | None) -> DataFrame:
    """K6 at the end of the input: the timeouts (D10) among the requests that the stream has not
    emitted. ``watermark``: the query's last watermark; requests whose window closed well before it
    are settled and not looked at again."""
    late = requests
    if watermark:
        late = late.filter(F.col("ts") + F.expr(f"INTERVAL {limit}") >= F.lit(watermark).cast("timestamp") - F.expr("INTERVAL 1 SECOND"))
    late = late.join(emitted.select("event_id"), "event_id", "left_anti")
    out = join_request_timeouts(late, responses, limit)
    return out.select("user_id", "request_ts", "event_id")


def last_watermark(query) -> str | None:
    """The watermark that a finished query reached."""
    p = query.lastProgress
    return None if not p else (p.get("eventTime") or {}).get("watermark")


# ---------------------------------------------------------------------------- K7
def stream_audit(stream: DataFrame, target: str, audit: str, keys: list[str], table_name: str, now,
                 op_col: str | None = None):
    """K7: a stream of row versions against a target table kept as versioned folders. Every
    micro-batch appends its change records to ``audit``: INSERT for a new key, UPDATE for a stored
    one (also with equal values, as the row trigger logs every update), and DELETE where ``op_col``
    says ``DELETE`` and the key is stored. Its versions go to ``target`` (deletions as marks); both
    under ``batch_id=N``, so a replayed batch rewrites the same folders. The target's
    ``batch_id=-1`` holds the initial snapshot. A micro-batch holds at most one version per key.
    Returns a DataStreamWriter."""

    def each(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        cols = [c for c in batch.columns if c != op_col]
        rest = [c for c in cols if c not in keys]
        gone = F.coalesce(F.col(op_col) == "DELETE", F.lit(False)) if op_col else F.lit(False)
        versions = batch.select(*cols, gone.alias("__deleted")).persist()
        try:
            # only the keys this batch touches, then their current version: the latest batch that
            # wrote them (an aggregate over the touched keys, not over the whole table)
            stored = spark.read.option("mergeSchema", "true").parquet(target).filter(F.col("batch_id") < batch_id)
            deleted = F.col("__deleted") if "__deleted" in stored.columns else F.lit(False)
            stored = stored.withColumn("__deleted", F.coalesce(deleted, F.lit(False)))
            stored = stored.join(versions.select(*keys), keys, "left_semi")
            cur = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest, "__deleted"), "batch_id").alias("__v")).filter("NOT __v.__deleted")
            j = versions.join(cur, keys, "left")
            had = F.col("__v").isNotNull()
            op = F.when(F.col("__deleted"), F.when(had, "DELETE")).otherwise(F.when(had, "UPDATE").otherwise("INSERT"))
            opts = {"ignoreNullFields": "false"}
            old = F.to_json(F.struct(*[(F.col(c) if c in keys else F.col(f"__v.{c}")).alias(c) for c in cols]), opts)
            new = F.to_json(F.struct(*[F.col(c) for c in cols]), opts)
            log = j.withColumn("operation", op).filter(F.col("operation").isNotNull()).select(
                *keys, F.lit(table_name).alias("table_name"), "operation", F.lit(None).cast("int").alias("user_id"),
                F.when(F.col("operation") != "INSERT", old).alias("old_values"),
                F.when(F.col("operation") != "DELETE", new).alias("new_values"),
                changes._lit_ts(now).alias("timestamp"))
            log.write.mode("overwrite").parquet(_batch_dir(audit, batch_id))
            versions.write.mode("overwrite").parquet(_batch_dir(target, batch_id))
        finally:
            versions.unpersist()

    return stream.writeStream.foreachBatch(each)


def compact_versions(spark: SparkSession, target: str, keys: list[str], through: int) -> DataFrame:
    """The current rows of a versioned target through batch ``through``: what a compaction writes as
    a new initial snapshot."""
    v = spark.read.option("mergeSchema", "true").parquet(target).filter(F.col("batch_id") <= through)
    rest = [c for c in v.columns if c not in keys and c != "batch_id"]
    last = v.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("__v"))
    out = last.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest])
    return out.filter(~F.coalesce(F.col("__deleted"), F.lit(False))).drop("__deleted") if "__deleted" in rest else out
