"""Operator 10, SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64-bit majority votes over the hashes of word shingles. Two fingerprints are linked
if they differ in at most ``RADIUS`` bits. Bit i belongs to a non-zero vector m(i) of GF(2)^(r+1);
table v keeps the bits with m(i)·v = 1. The at most r vectors of a pair's differing bits leave some
non-zero v orthogonal to all of them, so every linked pair agrees on all kept bits of one of the
2^(r+1)-1 tables. A bucket gives the links of a spanning forest of its members, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root
from . import common
from .components import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: A bucket with more members than this is dealt by a second set of masks over its open bits.
SPLIT = 2048


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text: 0 for a null text or one without words."""
    words = text.lower().split() if text else []  # ASCII letters and white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate(([0], ends[: n - 1])).tolist()
    last = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[k : k + (1 << 16)], last[k : k + (1 << 16)], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp long) of every row; h is a 64-bit hash of the text."""
    common.small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in common.byte_column(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "h", "fp"])

    return source.mapInArrow(run, "doc_id long, h long, fp long")


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit numbers such that any ``radius`` of them are all open in one mask."""
    vectors = (1 << (radius + 1)) - 1
    kept = {b: 1 + k % vectors for k, b in enumerate(bits)}
    return [sum(1 << b for b, m in kept.items() if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _tables(masks: list[int], fp: str = "fp") -> Column:
    return F.array(*[F.struct(F.lit(v).alias("v"), F.col(fp).bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for v, m in enumerate(masks)])


def forest(members: np.ndarray, radius: int, rows: int = 256) -> np.ndarray:
    """For each of the distinct fingerprints, the smallest member index it is connected to by steps
    of at most ``radius`` bits. Works in blocks of ``rows`` so that memory stays bounded."""
    n = len(members)
    label = np.arange(n)
    while True:
        before = label.copy()
        for k in range(0, n, rows):
            near = np.bitwise_count(members[k : k + rows, None] ^ members[None, :]) <= radius
            low = np.where(near, label[None, :], n).min(axis=1)
            label[k : k + rows] = np.minimum(label[k : k + rows], low)
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


def _bucket_links(buckets: DataFrame, keys: list[str], radius: int, partitions: int) -> DataFrame:
    """Links (a, b) that connect what is linked within each bucket."""
    placed = buckets.select(*keys, "fp").repartition(partitions, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_fps = None, []

        def links() -> pa.RecordBatch:
            members = np.unique(np.concatenate(open_fps)).view(np.uint64)
            label = forest(members, radius)
            some = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(members[some].view(np.int64)), pa.array(members[label[some]].view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = np.stack([np.asarray(batch.column(k), np.int64) for k in range(len(keys))], axis=1)
            fps = np.asarray(batch.column(len(keys)), np.int64)
            edges = np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(fps)], strict=True):
                key = columns[a].tolist()
                if key != open_key:
                    if sum(map(len, open_fps)) > 1:
                        yield links()
                    open_key, open_fps = key, []
                open_fps.append(fps[a:b].copy())
        if sum(map(len, open_fps)) > 1:
            yield links()

    return placed.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Links that connect exactly what pairs of distinct fingerprints (column fp) within the radius
    connect.

    Buckets are counted first (with partial sums). Those of up to ``split`` members are searched
    whole; the members of larger ones are dealt again by masks over the bits that their table left
    open, which leaves so few open bits that a second bucket is bounded by the masks themselves.
    """
    spark = fps.sparkSession
    parts = common.shuffle_partitions(spark)
    masks = covering_masks(list(range(64)), radius)
    dealt = fps.select("fp", F.explode(_tables(masks)).alias("t")).select("fp", "t.v", "t.key")
    sizes = dealt.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = dealt.join(sizes, ["v", "key"]).checkpoint()
    small = _bucket_links(shared.where(F.col("n") <= split), ["v", "key"], radius, parts)
    finer = F.lit(None)
    for v, m in enumerate(masks):
        second = covering_masks([b for b in range(64) if not m >> b & 1], radius)
        finer = F.when(F.col("v") == v, F.transform(_tables(second), lambda t: F.struct(t["v"].alias("u"), t["key"].alias("sub")))).otherwise(finer)
    large = shared.where(F.col("n") > split).select("v", "key", "fp", F.explode(finer).alias("s")).select("v", "key", "s.u", "s.sub", "fp")
    return small.unionByName(_bucket_links(large, ["v", "key", "u", "sub"], radius, parts))


def _placed(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, split: int) -> DataFrame:
    """(doc_id, h, fp, root, component_id) of every row; root names the component."""
    checkpoint_root(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint()
    roots = connected_components(links(distinct.select("fp"), radius, split))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, fingerprint (16 hex digits), component_id: the
    smallest id reachable over links.

    Null and empty texts have fingerprint zero and are linked like any other. Equal texts share a
    fingerprint and are collapsed before the search. Null ids get rows, too, and never become a
    component's id unless it holds nothing else (then it is null). Other columns are ignored.
    """
    found = _placed(docs, id_col, text_col, shingle, radius, split)
    return found.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: with the smallest id; of several texts
    with that id the one with the smallest hash, of equal ones the smallest row."""
    found = _placed(docs, id_col, text_col, shingle, radius, split).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = found.groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    found = found.groupBy("root").agg(F.min(F.struct("h", "doc_id", "n")).alias("k")).select(F.col("k.h").alias("__h"), F.col("k.doc_id").alias("__id"), F.col("k.n").alias("__n"))
    same = docs[id_col].cast("long").eqNullSafe(found["__id"]) & (F.xxhash64(docs[text_col].cast("string")) == found["__h"])
    kept = docs.join(found, same).drop("__h", "__id")
    several = kept.where("__n > 1").drop("__n")
    first = several.groupBy(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h")).agg(F.min(F.struct(*docs.columns)).alias("__r"))
    return kept.where("__n = 1").drop("__n").unionByName(first.select("__r.*"))
