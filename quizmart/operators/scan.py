"""Skew-proof ordered scans: running sums, positions and previous/next rows per key.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task, so a key that
holds a third of the data becomes one third of the job in one task. These helpers compute the
same results as the window functions with a two-phase scan instead:

1. ``repartitionByRange(P, key…, order…)`` — balanced partitions; a hot key is split across
   several consecutive partitions.
2. Per (partition, key) totals — an aggregate combined inside each partition. A key that
   started in an earlier partition can only be the *first* key of a later one, so the carry-in
   table has at most one row per partition (≤ P rows) and is broadcast with that bound.
3. One pass per partition (Arrow batches through ``mapInPandas``) adds the carry-in to the
   in-partition cumulative sum. No second shuffle.

The range-partitioned rows are written once with ``checkpoint()`` to the shared checkpoint folder
so that both passes read identical partitions (range bounds are sampled, and re-sampling over a
re-executed shuffle could move rows between partitions).

``previous_in_key`` then finds the preceding row by an equi join on (key, position - 1), whose
keys are unique, instead of ``lag`` over a skewed window.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmart.session import checkpoint_root

_V, _PID, _CARRY, _TOT = "__scan_v", "__scan_pid", "__scan_carry", "__scan_tot"


# Target input bytes per range partition. Files are compressed: 16 MB hold about a million events, which
# one task sorts whole.
PARTITION_BYTES = 16 * 1024 * 1024


def input_partitions(df: DataFrame, bytes_per_task: int | None = None) -> int:
    """About one partition per ``bytes_per_task`` (PARTITION_BYTES) of the data that ``df`` reads: the
    sizes of its plan's leaves (files, tables) summed. Where a leaf has no size, at least
    ``spark.sql.shuffle.partitions``."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total, least = 0, 1
    for i in range(leaves.size()):
        size = int(str(leaves.apply(i).stats().sizeInBytes()))
        if size < 1 << 60:
            total += size
        else:  # the default of plans without statistics
            least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // (bytes_per_task or PARTITION_BYTES)))


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Range partitions of an ordered pass: by the size of its input, without an upper bound (what
    is broadcast per partition are a few numbers)."""
    return int(num_partitions) if num_partitions else input_partitions(df)


def _starts(columns: list[pa.Array], n: int) -> np.ndarray:
    """Where a key differs from the row before (NULL equals NULL); the first row is True."""
    start = np.zeros(n, dtype=bool)
    start[0] = True
    for c in columns:
        if isinstance(c, pa.DictionaryArray):
            c = c.dictionary_decode()
        same = pc.fill_null(pc.equal(c.slice(1), c.slice(0, n - 1)), False)
        both_null = pc.and_(c.slice(1).is_null(), c.slice(0, n - 1).is_null())
        start[1:] |= ~np.asarray(pc.or_(same, both_null))
    return start


def _scan_batches(keys: list[str], out: str, out_is_long: bool):
    """Arrow pass: only keys, value and carry are looked at; the other columns go through as they
    are."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key of the last row seen in this partition
        run = 0      # running value at that row
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.schema.names
            columns = [batch.column(names.index(k)) for k in keys]
            v = np.asarray(pc.fill_null(batch.column(names.index(_V)), 0))
            carry = np.asarray(pc.fill_null(batch.column(names.index(_CARRY)), 0))
            start = _starts(columns, n)
            first = [c[0].as_py() for c in columns]
            continues = last is not None and first == last
            last = [c[n - 1].as_py() for c in columns]
            at = np.flatnonzero(start)
            sums = np.cumsum(v)
            before = np.where(at > 0, sums[at - 1], 0)
            base = carry[at] - before  # what a group adds to the batch's running sum
            if continues:
                base[0] = run - before[0]
            res = sums + np.repeat(base, np.diff(np.append(at, n)))
            run = res[-1]
            kept = [i for i, x in enumerate(names) if x not in (_V, _CARRY, _PID)]
            result = pa.array(res.astype("int64") if out_is_long else res.astype("float64"))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], result], names=[*[names[i] for i in kept], out])
    return fn


def _last_key_totals(keys: list[str], value: str, out: str):
    """Arrow pass over a sorted partition: the total of ``value`` over its last key."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, row = None, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.schema.names
            columns = [batch.column(names.index(k)) for k in keys]
            at = int(np.flatnonzero(_starts(columns, n))[-1])
            whole = at == 0 and [c[0].as_py() for c in columns] == last
            v = pc.sum(batch.column(names.index(value)).slice(at)).as_py() or 0
            total = total + v if whole else v
            last = [c[n - 1].as_py() for c in columns]
            row = batch.slice(n - 1, 1)
        if row is not None:
            kind = row.column(row.schema.names.index(value)).type
            kept = [i for i, x in enumerate(row.schema.names) if x != value]
            yield pa.RecordBatch.from_arrays([*[row.column(i) for i in kept], pa.array([total], kind)],
                                             names=[*[row.schema.names[i] for i in kept], out])
    return fn


def ranged_checkpoint(df: DataFrame, sort_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """Range-partition by ``sort_cols``, sort within partitions and checkpoint (eager, reliable, in
    the shared checkpoint folder): later passes read fixed partitions, so
    ``spark_partition_id()`` names the same rows in every pass."""
    checkpoint_root(df.sparkSession)
    n = _num_partitions(df, num_partitions)
    order = [F.col(c).asc_nulls_first() for c in sort_cols]
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)


def running_sum(df: DataFrame, keys: Iterable[str], order: Iterable[str], value: Column, out: str,
                num_partitions: int | None = None, as_double: bool = False) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY keys ORDER BY order ROWS UNBOUNDED PRECEDING)`` as ``out``.

    ``order`` should make the order total (add an id); ties are otherwise broken arbitrarily,
    as with the window function. NULL values add 0. Works with ``keys=[]`` (one global order)
    without pulling everything into one partition.

    The range-partitioned rows are checkpointed once, so the summary pass and the main pass see
    the same partitions.
    """
    keys, order = list(keys), list(order)
    out_cols = list(df.columns)
    base = df
    if not keys:  # one global order: a constant key keeps one code path
        base = base.withColumn("__scan_all", F.lit(0))
        keys = ["__scan_all"]
    sort_cols = keys + order
    vt = "double" if as_double else "bigint"
    # Materialise the range-partitioned, sorted rows once: both passes then read identical
    # partitions, whatever the optimiser does to either branch, and a lost executor re-reads the
    # checkpoint instead of re-sampling range bounds.
    ranged = ranged_checkpoint(base.withColumn(_V, value.cast(vt)), sort_cols, num_partitions)
    tot_type = T.DoubleType() if as_double else T.LongType()
    # Only a partition's last key can go on in later partitions: its total, one row per partition,
    # is all that has to be known of it. The checkpointed partitions are fixed, so
    # spark_partition_id() names the same partition here and in the final pass.
    totals = ranged.select(F.spark_partition_id().alias(_PID), *keys, _V).mapInArrow(
        _last_key_totals(keys, _V, _TOT), T.StructType(
            [T.StructField(_PID, T.IntegerType()), *[ranged.schema[k] for k in keys], T.StructField(_TOT, tot_type)]))
    # P rows in one order: the carry into partition p for key k is the sum over the earlier
    # partitions that end with k. A partition that begins with k but does not end with it is not in
    # the totals of k, so the sums are taken per key and looked up by the next partition.
    w = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, 0)
    cnames = {c: f"__scan_c{i}" for i, c in enumerate([_PID, *keys])}
    # A key's partitions are consecutive, so the sum up to partition p is the carry into p + 1; empty
    # partitions in between are bridged by the key's next partition number.
    ids = Window.orderBy(_PID)
    after = totals.withColumn("__next", F.lead(_PID).over(ids))
    carry = (after.withColumn(_CARRY, F.sum(_TOT).over(w))
             .filter(F.col("__next").isNotNull() & (F.col(_CARRY) != 0))
             .select(F.col("__next").alias(cnames[_PID]), *[F.col(k).alias(cnames[k]) for k in keys], _CARRY))
    cond = F.lit(True)
    for c, nm in cnames.items():
        cond = cond & F.col(c).eqNullSafe(F.col(nm))
    joined = (ranged.withColumn(_PID, F.spark_partition_id())
              .join(F.broadcast(carry), cond, "left").drop(*cnames.values()))
    # Already in order (broadcast join streams the checkpointed side in order); Spark drops this
    # sort as redundant when the ordering is known.
    ordered = joined.sortWithinPartitions(*[F.col(x).asc_nulls_first() for x in sort_cols])
    schema = T.StructType(list(base.schema.fields) + [T.StructField(out, tot_type, True)])
    res = ordered.mapInArrow(_scan_batches(keys, out, not as_double), schema)
    return res.select(*out_cols, out)


def sequence_number(df: DataFrame, keys: Iterable[str], order: Iterable[str], out: str,
                    num_partitions: int | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order)`` as ``out`` (skew-proof)."""
    return running_sum(df, keys, order, F.lit(1), out, num_partitions)


def previous_in_key(df: DataFrame, keys: Iterable[str], order: Iterable[str], cols: Iterable[str],
                    prefix: str = "prev_", pos_col: str = "__pos", keep_pos: bool = False) -> DataFrame:
    """Attach the previous row's ``cols`` (``LAG(c) OVER (PARTITION BY keys ORDER BY order)``).

    Joins on (keys, position - 1): unique join keys, so no task gets a hot key's whole group.
    """
    keys, cols = list(keys), list(cols)
    pos = sequence_number(df, keys, order, pos_col)
    prev = pos.select(*[F.col(k).alias(f"__k_{k}") for k in keys],
                      (F.col(pos_col) + 1).alias("__next_pos"),
                      *[F.col(c).alias(prefix + c) for c in cols])
    cond = F.col(pos_col) == F.col("__next_pos")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    res = pos.join(prev, cond, "left").drop("__next_pos", *[f"__k_{k}" for k in keys])
    return res if keep_pos else res.drop(pos_col)
