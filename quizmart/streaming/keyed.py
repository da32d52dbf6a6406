"""Streams whose state is keyed in the state store: nothing already written is read again.

* K1, :func:`stream_first_answers`: the first answer per key in arrival order.
* K1, :func:`stream_first_answers_within`: the same with state for as long as a watermark says.
* K6, :func:`stream_timeouts`: join requests without a response, by event-time timers.

State lives in RocksDB (``streams.run_available_now``), which looks up the keys of a micro-batch only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from quizmart.operators import changes
from quizmart.streaming.streams import STATE_BUCKETS, _batch_dir, bucket_of, id_of, id_or


# ---------------------------------------------------------------------------- K1
def stream_first_answers(stream: DataFrame, answers: DataFrame, keys: Iterable[str] = ("game_id", "user_id", "round_no"), order: Iterable[str] = ("answered_at",)) -> DataFrame:
    """K1 with exact state: of every key its first answer by arrival over micro-batches, and by ``order``
    and then all columns within one; write it with :func:`write_first_answers`.

    A streaming aggregate, combined in each task before the shuffle: the smallest row by (time of its
    micro-batch, ``order``, other columns) and the number of rows. An unknown answer is left out; a row
    with a NULL key part is a key of its own, so it comes with its copies as one row and their number.
    A replayed micro-batch has its first run's time.
    """
    keys, order = list(keys), list(order)
    known = changes.score_all(stream, answers).filter(F.col("right_wrong").isNotNull())
    rest = [c for c in known.columns if c not in keys and c not in order]
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    own = F.when(~whole, F.to_json(F.struct(*known.columns)))
    row = F.struct(F.col("__now").alias("arrived"), *order, *rest)
    timed = known.withColumn("own_key", own).withColumn("__now", F.current_timestamp())
    return timed.groupBy(*keys, "own_key").agg(F.min(row).alias("first"), F.max("__now").alias("seen"), F.count(F.lit(1)).alias("n"))


def write_first_answers(first: DataFrame, sink: str, keys: Iterable[str] = ("game_id", "user_id", "round_no")):
    """Sink of :func:`stream_first_answers` in ``update`` mode: each trigger writes the keys it has seen to
    ``batch_id=N``, under ``accepted=true`` with the answer if it has accepted one, else under
    ``accepted=false``; ``n`` is the number of answers of the key so far (all but one rejected; none if a
    key part is NULL, then a row stands for ``n`` equal accepted answers). Nothing is read."""
    keys = list(keys)
    columns = [f for f in first.schema["first"].dataType.names if f != "arrived"]

    def each(batch: DataFrame, batch_id: int):
        accepted = F.col("own_key").isNotNull() | (F.col("first.arrived") == F.col("seen"))
        batch.select(*keys, *[F.col(f"first.{c}").alias(c) for c in columns], "n", accepted.alias("accepted")) \
            .write.mode("overwrite").partitionBy("accepted").parquet(_batch_dir(sink, batch_id))

    return first.writeStream.outputMode("update").foreachBatch(each)


def stream_first_answers_within(stream: DataFrame, answers: DataFrame, delay: str, ts: str = "answered_at",
                                keys: Iterable[str] = ("game_id", "user_id", "round_no")) -> DataFrame:
    """K1 with bounded state: the accepted answers, where a key is forgotten once the watermark (``delay``
    behind the latest ``ts``) has passed its answer; a later one of the same key is then accepted
    again. Of equal keys in one micro-batch any one is taken. Rows with a NULL key part never
    collide and are all accepted; an unknown answer is not."""
    keys = list(keys)
    known = changes.score_all(stream, answers).filter(F.col("right_wrong").isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return known.filter(whole).dropDuplicatesWithinWatermark(keys).unionByName(known.filter(~whole))


# ---------------------------------------------------------------------------- K6
_LONGS = T.ArrayType(T.LongType())
REQUEST_STATE = T.StructType([T.StructField(c, _LONGS) for c in ("open_user", "open_ts", "open_id", "heard_user", "heard_ts")])
TIMEOUTS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("request_us", T.LongType()), T.StructField("event_id", T.LongType())])


def _timeouts(limit_us: int):
    def fn(key, frames: Iterator[pd.DataFrame], state):
        got = state.get if state.exists else ([],) * 5
        user, ts, ids, heard_user, heard = (np.array(x, "int64") for x in got)
        watermark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for pdf in frames:
                asks = pdf["is_request"].to_numpy(bool)
                who, us = pdf["user_id"].to_numpy(), pdf["us"].to_numpy()
                user, ts, ids = np.append(user, who[asks]), np.append(ts, us[asks]), np.append(ids, pdf["event_id"].to_numpy()[asks])
                heard_user, heard = np.append(heard_user, who[~asks]), np.append(heard, us[~asks])
            # all in order of user and time, at equal times the requests first: the next response of every row
            n = len(user)
            whose, when = np.append(user, heard_user), np.append(ts, heard)
            response = np.arange(len(whose)) >= n
            order = np.lexsort((response, when, whose))
            after = np.where(response[order], np.arange(len(order)), len(order))
            after = np.minimum.accumulate(after[::-1])[::-1]
            found = np.append(order, -1)[after]  # -1: none comes after
            found[(found >= 0) & (whose[found] != whose[order])] = -1
            next_of = np.empty(len(order), "int64")
            next_of[order] = found
            next_of = next_of[:n]
            waits = (next_of < 0) | (when[next_of] > ts + limit_us) if n else np.empty(0, bool)
            user, ts, ids = user[waits], ts[waits], ids[waits]
        late = ts + limit_us < watermark
        out = pd.DataFrame({"user_id": user[late], "request_us": ts[late], "event_id": ids[late]})
        user, ts, ids = user[~late], ts[~late], ids[~late]
        heard_user, heard = heard_user[heard >= watermark], heard[heard >= watermark]  # a request that is still to come may have been answered
        if len(ts) or len(heard):
            state.update(tuple(x.tolist() for x in (user, ts, ids, heard_user, heard)))
            due = int(min(np.append(ts + limit_us, heard)))
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield out
    return fn


def stream_timeouts(events: DataFrame, is_request, is_response, limit_seconds: int, watermark: str, buckets: int = STATE_BUCKETS) -> DataFrame:
    """K6 by timers: (user_id, request_ts, event_id) of the requests without a response of the same user
    within ``limit_seconds`` (D10), each emitted when the watermark has passed its limit.

    State per bucket of users (``buckets``, see :data:`streams.STATE_BUCKETS`): the requests still open, and
    the responses that a late request may yet claim; both go when the watermark has passed them. All rows
    of ``events`` move the watermark, so a feed that ends with a heartbeat (a row of any other kind, late
    enough) leaves nothing pending. A NULL user has no responses.
    """
    e = events.withWatermark("ts", watermark)
    rows = e.select("user_id", "ts", "event_id", F.unix_micros("ts").alias("us"), is_request.alias("is_request"), is_response.alias("__r"))
    # names the event time, so that the filter stays above the watermark and heartbeats move it
    wanted = F.when(F.col("ts").isNotNull(), F.col("is_request") | (F.col("__r") & F.col("user_id").isNotNull()))
    rows = rows.filter(wanted).select(id_or("user_id"), "ts", id_or("event_id"), "us", "is_request")
    out = rows.withColumn("bucket", bucket_of(F.col("user_id"), buckets)).groupBy("bucket").applyInPandasWithState(
        _timeouts(limit_seconds * 1_000_000), TIMEOUTS, REQUEST_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(id_of("user_id"), F.timestamp_micros("request_us").alias("request_ts"), id_of("event_id"))
