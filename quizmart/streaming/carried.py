"""Streams that order all rows of a micro-batch and carry a small state to the next one.

Keyed stream state puts one key into one task, and a running total over all rows has no key at all.
These jobs run the distributed batch operator over each micro-batch in ``foreachBatch``, with what
earlier batches left prepended as rows: the waiting player of a lobby (K3), the open sockets and
their number (K4, K5). Batch N reads the state that batch N - 1 wrote and writes its own to
``batch_id=N``, as its results, so a replayed batch replaces both.

Rows are in (ts, event_id) order within a micro-batch; a row that arrives in a later batch comes
after those of earlier ones, as it does at the server.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmart.operators import changes
from quizmart.operators.scan import running_sum
from quizmart.operators.sessions import CHAT, CONNECT, DISCONNECT, REQUEST, _presence_deltas, lobby_fold
from quizmart.sources import stored
from quizmart.streaming.streams import _batch_dir

#: Time and id of the rows that stand for the carried state: before any event (as early as a pandas
#: time can be).
BEGIN = dt.datetime(1678, 1, 1)
BEGIN_ID = -(1 << 63)


def carried(spark: SparkSession, root: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """What the batch before left; nothing before the first. A state that cannot be read is an error."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_batch_dir(root, batch_id - 1))


def _begin(frame: DataFrame, like: DataFrame) -> list:
    return [F.lit(BEGIN).cast(like.schema["ts"].dataType).alias("ts"), F.lit(BEGIN_ID).cast("long").alias("event_id")]


def stream_lobby_pairs(stream: DataFrame, sink: str, state: str, lobby: str = "lobby", socket: str = "user_id",
                       allow_self_pair: bool = False, num_partitions: int | None = None):
    """K3 for lobbies of any size: FIFO pairing (F6) of each micro-batch by the distributed fold, from
    the waiting players that earlier batches left. ``sink`` gets (lobby, group_no, player1, player2,
    paired_at, event_id); ``state`` one row per lobby (waiter, groups formed). Returns a
    DataStreamWriter."""

    def each(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        ev = batch
        schema = T.StructType([ev.schema["lobby"], T.StructField("waiter", ev.schema["socket"].dataType), T.StructField("groups", T.LongType())])
        prior = carried(spark, state, batch_id, schema)
        here = ev.select("lobby").distinct()
        waiting = prior.filter(F.col("waiter").isNotNull()).join(here, prior["lobby"].eqNullSafe(here["lobby"]), "left_semi")
        first = waiting.select("lobby", *_begin(waiting, ev), F.col("waiter").alias("socket"), F.lit(REQUEST).alias("kind"))
        fold = lobby_fold(ev.unionByName(first), "lobby", "socket", allow_self_pair, num_partitions).persist()
        try:
            before = prior.select(F.col("lobby").alias("__l"), F.col("waiter").alias("__w"), F.col("groups").alias("__n"))
            pairs = fold.filter(F.col("row_kind") == "pair")
            out = pairs.join(before, pairs["lobby"].eqNullSafe(before["__l"]), "left")
            out.select("lobby", (F.col("group_no") + F.coalesce("__n", F.lit(0))).alias("group_no"), "player1", "player2", "paired_at", "event_id") \
                .write.mode("overwrite").parquet(_batch_dir(sink, batch_id))
            ends = fold.groupBy("lobby").agg(F.max_by("player1", F.when(F.col("row_kind") == "end", F.col("pid"))).alias("waiter"),
                                             F.count_if(F.col("row_kind") == "pair").alias("formed"))
            both = ends.withColumn("__here", F.lit(True)).join(before, ends["lobby"].eqNullSafe(before["__l"]), "full_outer")
            here = F.col("__here").isNotNull()
            both.select(F.when(here, F.col("lobby")).otherwise(F.col("__l")).alias("lobby"), F.when(here, F.col("waiter")).otherwise(F.col("__w")).alias("waiter"),
                        (F.coalesce("formed", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("groups")).write.mode("overwrite").parquet(_batch_dir(state, batch_id))
        finally:
            fold.unpersist()

    ev = stream.filter(F.col("kind").isin(REQUEST, DISCONNECT)).select(F.col(lobby).alias("lobby"), "ts", "event_id", F.col(socket).alias("socket"), "kind")
    return ev.writeStream.foreachBatch(each)


def stream_connections(stream: DataFrame, sink: str, state: str, socket: str = "user_id", connect: str = CONNECT):
    """K4's gauge and K5's recipients: every event with ``connected``, the open sockets after it (F7), and
    every chat message with ``recipients``, those but the sender's (D7).

    A micro-batch's sockets that were open before it are opened first, without changing the gauge;
    the running total of its openings and closings starts from the number that were open. ``sink``
    gets (event_id, ts, socket, kind, connected, recipients), ``state`` the open sockets. Returns a
    DataStreamWriter."""

    def each(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        ev = batch
        prior = carried(spark, state, batch_id, T.StructType([ev.schema[socket]]))
        base = prior.count()
        here = ev.select(socket).distinct()
        again = prior.join(here, socket, "left_semi")
        first = again.select(*_begin(again, ev), socket, F.lit(connect).alias("kind"))
        deltas = _presence_deltas(ev.unionByName(first), socket, connect).persist()
        try:
            line = running_sum(deltas.filter(F.col("event_id") != BEGIN_ID), [], ["ts", "event_id"], F.col("delta"), "__c")
            connected = F.col("__c") + F.lit(base)
            others = F.when(F.col("kind") == CHAT, connected - F.col("sender_open").cast("long"))
            line.select("event_id", "ts", socket, "kind", connected.alias("connected"), others.alias("recipients")).write.mode("overwrite").parquet(_batch_dir(sink, batch_id))
            still = deltas.groupBy(socket).agg(F.sum("delta").alias("__open")).filter(F.col("__open") > 0).select(socket)
            prior.join(here, socket, "left_anti").unionByName(still).write.mode("overwrite").parquet(_batch_dir(state, batch_id))
        finally:
            deltas.unpersist()

    # a micro-batch is read several times and cannot be pruned there: only these columns are computed
    return stream.select("event_id", "ts", socket, "kind").writeStream.foreachBatch(each)


def stream_audit_stored(stream: DataFrame, root: str, audit: str, table_name: str, now, op_col: str | None = None):
    """K7 against a bucketed stored table: every micro-batch reads and rewrites only the buckets of the
    keys it touches, in the one version that is current, and commits them by the next manifest.

    The table (:func:`stored.create`, version 0) is at its version N before batch N, so a replayed batch
    starts from the same rows and replaces its own. What a trigger reads depends on the buckets it
    touches and not on how many batches came before. ``audit`` gets the change records as in
    ``stream_audit``. A micro-batch holds at most one version per key. Returns a DataStreamWriter."""

    def each(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        m = stored.manifest(spark, root, batch_id)
        keys, cols = m.keys, m.schema.names
        gone = F.coalesce(F.col(op_col) == "DELETE", F.lit(False)) if op_col else F.lit(False)
        versions = batch.select(*cols, gone.alias("__deleted")).persist()
        try:
            touched = {r[0] for r in versions.select(stored.bucket_of(keys, m.buckets)).distinct().collect()}  # at most the buckets
            files = [f for f, b in m.files.items() if b in touched]
            old = stored.read_files(spark, root, m, files).select(F.struct(*cols).alias("__old"), *[F.col(k).alias(f"__k_{k}") for k in keys])
            new = versions.select(F.struct(*cols).alias("__new"), "__deleted", *keys)
            same = F.lit(True)
            for k in keys:
                same = same & (F.col(k) == F.col(f"__k_{k}"))
            both = new.join(old, same, "full_outer").persist()
            given, had = F.col("__new").isNotNull(), F.col("__old").isNotNull()
            op = F.when(F.col("__deleted"), F.when(had, "DELETE")).otherwise(F.when(had, "UPDATE").otherwise("INSERT"))
            opts = {"ignoreNullFields": "false"}
            log = both.filter(given).withColumn("operation", op).filter(F.col("operation").isNotNull())
            log.select(*[F.col(f"__new.{k}").alias(k) for k in keys], F.lit(table_name).alias("table_name"), "operation", F.lit(None).cast("int").alias("user_id"),
                       F.when(F.col("operation") != "INSERT", F.to_json("__old", opts)).alias("old_values"),
                       F.when(F.col("operation") != "DELETE", F.to_json("__new", opts)).alias("new_values"),
                       changes._lit_ts(now).alias("timestamp")).write.mode("overwrite").parquet(_batch_dir(audit, batch_id))
            current = both.filter(~given | ~F.col("__deleted")).select(F.when(given, F.col("__new")).otherwise(F.col("__old")).alias("__row")).select(*[F.col(f"__row.{c}").alias(c) for c in cols])
            written = stored.write_files(current, root, batch_id + 1, keys, m.buckets)
            stored.commit(spark, root, m._replace(version=batch_id + 1, files={f: b for f, b in m.files.items() if b not in touched} | written))
            both.unpersist()
        finally:
            versions.unpersist()

    return stream.writeStream.foreachBatch(each)
