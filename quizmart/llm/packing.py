"""Operator 9, best-fit packing planned on a histogram of lengths.

Documents are tokenised and cut into pieces; the pieces are counted by length (at most ``capacity``
counts). Best fit over those counts gives runs of equal placements; every piece takes the placement
with its rank within its length. Only the histogram and the runs pass through the driver: both are
bounded by the capacity, not by the number of documents.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root
from . import common

CAPACITY = 4096
END_ID = 1

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Words that are encoded as one text.
JOINED = 500
#: Ranks of one length are joined to the plan in chunks of so many.
CHUNK = 4096


def word_table(path: str) -> common.WordTable:
    return common.memo(("packing", path), lambda: _build(path))


def _build(path: str) -> common.WordTable:
    """Words (between ASCII white space) with their token ids.

    The vocabulary's own rules never join tokens over white space and lower-case all letters, so
    the words of a text can be encoded one by one; so can the letter runs, digits and runs of signs
    within a word without special tokens, whose memo serves the words not met before.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
    ends_word[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
    runs = re.compile(rb"[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")

    def together(words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words that are one unit each, encoded as one text: a unit's last id ends a word."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        lengths = np.diff(np.flatnonzero(ends_word[ids]), prepend=-1)
        return (ids, lengths) if len(lengths) == len(words) and lengths.sum() == len(ids) else None

    def alone(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths

    def encode(words: list[bytes]):
        texts = [w.decode("utf-8", "replace") for w in words]
        units = np.fromiter((x.isalpha() or x.isascii() and bool(runs.fullmatch(w)) and "<|" not in x and "'" not in x for x, w in zip(texts, words, strict=True)), bool, len(words))
        flat: list[np.ndarray] = [np.zeros(0, np.int32)]
        lengths = np.zeros(len(words), np.int64)
        order: list[np.ndarray] = [np.zeros(0, np.int64)]
        for joined, where in ((True, np.flatnonzero(units)), (False, np.flatnonzero(~units))):
            for k in range(0, len(where), JOINED):
                at = where[k : k + JOINED]
                some = [texts[i] for i in at.tolist()]
                ids, n = (joined and together(some)) or alone(some)
                flat.append(ids)
                lengths[at] = n
                order.append(at)
        # from the order of encoding to that of the words
        done = np.concatenate(order)
        place = np.zeros(len(words), np.int64)
        place[done] = common.starts(lengths[done])[:-1]
        return (common.ragged(np.concatenate(flat), place, lengths), lengths), np.zeros((len(words), 0), np.int32)

    parts = common.WordTable(encode, 0, np.int32, limit=400_000)

    def describe(words: list[bytes]):
        cut, counts = [], []
        for w in words:
            if w.isalpha():  # ASCII letters
                cut.append(w.lower())
                counts.append(1)
                continue
            if w.isascii() and b"'" not in w and b"<|" not in w:
                found = runs.findall(w.lower())
                if sum(map(len, found)) == len(w):
                    cut.extend(found)
                    counts.append(len(found))
                    continue
            cut.append(w)
            counts.append(1)
        ids = parts.lookup(cut)
        lengths = parts.lengths[ids].astype(np.int64)
        ends = common.starts(lengths)[common.starts(np.array(counts, np.int64))]
        return (common.ragged(parts.flat, parts.offsets[ids], lengths), np.diff(ends)), np.zeros((len(words), 0), np.int32)

    return common.WordTable(describe, 0, np.int32)


def token_ids(texts: list[bytes | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by ``END_ID``, and the starts of the texts in them."""
    table = word_table(path)
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.split() if t else []
        words += w
        counts[i] = len(w)
    rows = table.lookup(words)
    lengths = table.lengths[rows].astype(np.int64)
    flat = common.ragged(table.flat, table.offsets[rows], lengths)
    ends = common.starts(lengths)[common.starts(counts)]
    per = np.diff(ends)
    at = common.starts(per + 1)
    out = np.full(at[-1], END_ID, np.uint32)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), per)] = flat
    return out, at


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32. A null or empty text is one
    piece that holds only the end id; repeated rows are packed each; other columns are ignored."""
    common.small_batches(docs.sparkSession)
    path = path or os.path.join(common.TOKENIZER_DIR, "word_bpe_49k.json")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", common.WORDS_BYTES):
                ids, at = token_ids(common.byte_column(part, "text"), path)
                rows: list[tuple] = []
                for doc, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for k, s in enumerate(range(a, b, capacity)):
                        e = min(b, s + capacity)
                        rows.append((doc, k, s - a, e - s, zlib.crc32(ids[s:e].astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("doc_id", id_col)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths.

    Returns runs ``(length, first_rank, n, first_sequence, offset)``: the pieces of that length with
    ranks from ``first_rank`` on take that offset in ``n`` consecutive sequences. Sequences that are
    filled alike are kept as ranges, so a run places many pieces at once.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first sequence, number)
    free: list[int] = []
    runs, next_sequence = [], 0

    def put(rest: int, first: int, n: int) -> None:
        if rest and n:
            if rest not in room:
                room[rest] = []
                insort(free, rest)
            room[rest].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(free, length)
            if k < len(free):
                rest = free[k]
                first, n = room[rest].pop()
                if not room[rest]:
                    del room[rest], free[k]
            else:  # as many new sequences as these pieces fill, and one for those that remain
                rest, first = capacity, next_sequence
                n = max(1, left // (capacity // length))
                next_sequence += n
            take = min(n, left)
            runs.append((length, rank, take, first, capacity - rest))
            put(rest - length, first, take)
            put(rest, first + take, n - take)
            left, rank = left - take, rank + take
    return runs


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with the ``sequence_id`` and ``offset`` where they go.

    Null texts count as empty, null ids form documents of their own row each; ties of length are
    ordered by id, piece and checksum, and equal rows in any order (they are interchangeable). An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    checkpoint_root(spark)
    cut = pieces(docs, id_col, text_col, path, capacity).withColumnRenamed(id_col, "doc_id").checkpoint()
    blocks = max(16, 4 * common.shuffle_partitions(spark))
    cut = cut.withColumn("__block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    counts = cut.groupBy("length", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(plan(histogram, capacity), "length long, __first long, __n long, __sequence long, offset long")
    runs = runs.withColumn("__chunk", F.explode(F.sequence(F.expr(f"__first div {CHUNK}"), F.expr(f"(__first + __n - 1) div {CHUNK}"))))
    within = Window.partitionBy("length", "__block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        cut.withColumn("__row", F.row_number().over(within) - 1)
        .join(base, ["length", "__block"])
        .withColumn("__rank", F.col("__base") + F.col("__row"))
        .withColumn("__chunk", F.expr(f"__rank div {CHUNK}"))
    )
    placed = ranked.join(runs, ["length", "__chunk"]).where("__rank >= __first AND __rank < __first + __n")
    return placed.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", F.expr("__sequence + __rank - __first").alias("sequence_id"), "offset")
