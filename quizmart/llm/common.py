"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import BATCH_BYTES, checkpoint_root, small_batches  # noqa: F401

#: Code points that separate words: space and tab to carriage return.
SPACE = b" \t\n\v\f\r"

#: Directory of the public vocabulary files on every node.
TOKENIZER_DIR = "/opt/tokenizers"

#: Bytes of the texts whose words a worker looks up at once.
WORDS_BYTES = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a written table in the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose ``column`` holds at most about ``limit`` bytes (one row
    at least), so that the memory of a step does not follow the batch size."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield batch.slice(first)


def starts(lengths: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums with the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged(values: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenates ``values[o:o+n]`` over all (o, n)."""
    at = starts(lengths)
    return values[np.repeat(offsets - at[:-1], lengths) + np.arange(at[-1])]


_MEMO: dict[tuple, object] = {}


def memo(key: tuple, build: Callable[[], object]):
    """What ``build`` gives, kept by a worker process until it is asked for something else: stages
    that follow each other in one worker do not add up their memos."""
    if key not in _MEMO:
        _MEMO.clear()
        _MEMO[key] = build()
    return _MEMO[key]


#: Bytes of words that a memo holds at most before it starts anew.
KEY_BYTES = 48 << 20


class _Index(dict):
    """Numbers its keys in order of first use; ``new`` lists the keys not yet described."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class WordTable:
    """Per-worker memo of what a word maps to: a ragged list of ids and fixed columns.

    ``describe(words)`` gives ``(id lists, array [n, columns])`` for words not seen before; the id
    lists are a list of them or a pair of arrays, all ids end to end and the length of each list.
    Holds about ``limit`` words; beyond that the words used once are forgotten (results do not
    depend on what is remembered).
    """

    def __init__(self, describe: Callable[[list[bytes]], tuple[list | tuple, np.ndarray]], columns: int, dtype, limit: int = 600_000) -> None:
        self.describe, self.limit, self.width, self.dtype = describe, limit, columns, dtype
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.columns = np.zeros((0, self.width), self.dtype)
        self.lengths = np.zeros(0, np.int32)
        self.offsets = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int64)
        self.size, self.flat_size, self.held = 0, 0, 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if len(a) >= n:
            return a
        out = np.zeros((max(n, len(a) * 3 // 2 + 1024), *a.shape[1:]), a.dtype)
        out[: len(a)] = a
        return out

    def _add(self, ids: list | tuple[np.ndarray, np.ndarray], columns: np.ndarray) -> None:
        if isinstance(ids, tuple):
            flat, lengths = ids
        else:
            lengths = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
        n, k, total = len(lengths), self.size, len(flat)
        for name in ("columns", "lengths", "offsets", "uses"):
            setattr(self, name, self._room(getattr(self, name), k + n))
        self.flat = self._room(self.flat, self.flat_size + total)
        self.columns[k : k + n] = columns
        self.lengths[k : k + n] = lengths
        self.offsets[k : k + n] = starts(lengths)[:-1] + self.flat_size
        self.flat[self.flat_size : self.flat_size + total] = flat
        self.size, self.flat_size = k + n, self.flat_size + total

    def _forget(self) -> None:
        keep = np.flatnonzero(self.uses[: self.size] > 1) if self.held <= KEY_BYTES else np.zeros(0, np.int64)
        if len(keep) > self.limit // 2:
            keep = keep[np.argsort(-self.uses[keep], kind="stable")[: self.limit // 2]]
        words = np.empty(self.size, object)
        words[:] = list(self.index)
        words, ids = words[keep], [self.flat[o : o + n].copy() for o, n in zip(self.offsets[keep], self.lengths[keep], strict=True)]
        columns = self.columns[keep].copy()
        self._clear()
        for w in words:
            self.index[w] = len(self.index)
            self.held += len(w)
        self._add(ids, columns)

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of the words, valid until the next call."""
        if self.size > self.limit or self.held > KEY_BYTES:
            self._forget()
        out = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            new, self.index.new = self.index.new, []
            self.held += sum(map(len, new))
            self._add(*self.describe(new))
        self.uses[: self.size] += np.bincount(out, minlength=self.size)
        return out
