"""Operator 4, benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Three words of an item that follow each other, or leave one out, are a seed if few items of the whole
benchmark have them, or if they are the rarest of their stretch of the item: every stretch keeps some,
however alike the items are. A document passage around seed hits on neighbouring diagonals is aligned
with the item, and the normalised score decides. Spark counts the n-grams and chooses the seeds; the
chosen index is taken in blocks of bounded size, each of which is broadcast and meets all documents in
one pass without a shuffle. Seeds do not depend on the blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Places of a seed's words.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: A seed is in at most so many items, or in the fewest of all seeds that begin in its stretch of the item.
RARE_ITEMS, STRETCH = 3, 4
#: Items with fewer words are not aligned: they match where a sentence or line has just their words.
MIN_WORDS = 6
#: With fewer words than this, such a line tells no leak: the item matches nothing.
SHORT_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score as a share of a full match, and least number of equal words (or all of the item's).
MIN_SCORE, MIN_EQUAL = 0.5, 6
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 16 << 20
#: Cells of one row of alignments that run side by side.
CELLS = 1 << 16

#: ASCII signs count as white space when texts are compared.
_SIGNS = bytes.maketrans(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 31)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SHAPE = np.uint64(0xD6E8FEB86659FD93)
#: Scripts written without spaces (Thai to Khmer, kana, Han): their characters are words. Their signs
#: and dashes and quotation marks count as white space. All begin with a UTF-8 byte of 0xE0 or more.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_WIDE_SIGNS = re.compile("[\u2010-\u2027\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_BELOW_E0 = bytes(range(0xE0))
#: Where sentences and lines end: also U+3002 and the wide forms of ``!``, ``.``, ``:``, ``;``, ``?``.
_ENDS = re.compile(rb"[\n.!?:;]|\xe3\x80\x82|\xef\xbc[\x81\x8e\x9a\x9b\x9f]")


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased words without ASCII signs; single characters in scripts that do not space words."""
    if not text.isascii():
        lower = text.decode("utf-8", "replace").lower()
        if text.translate(None, _BELOW_E0):
            lower = _UNSPACED.sub(r" \g<0> ", _WIDE_SIGNS.sub(" ", lower))
        text = lower.encode("utf-8", "replace")
    return text.lower().translate(_SIGNS).split()


def _grams(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """For each shape the 64-bit hash of its words at every place, from the hashes of all words."""
    for k, shape in enumerate(SHAPES):
        n = max(0, len(hashes) - shape[-1])
        h = np.full(n, _SHAPE * np.uint64(k), np.uint64)
        for at, mix in zip(shape, _PLACES, strict=True):
            h += hashes[at : at + n] * mix
        yield h ^ (h >> np.uint64(29))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Block:
    """Some benchmark texts with the index of their seeds: rows of (key, text, seed hashes, places)."""

    def __init__(self, rows: list[tuple[str, bytes, list[int], list[int]]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.items = [], []
        self.short: dict[tuple[bytes, ...], list[int]] = {}
        seeds, items, places = [], [], []
        for name, text, hashes, at in rows:
            words = normal_words(text)
            k = len(self.names)
            self.names.append(name)
            if len(words) >= MIN_WORDS:
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32))
                h, p = self._apart(np.array(hashes, np.int64).view(np.uint64), np.array(at, np.int64), (len(words) // 4 + 4) // 2)
                seeds.append(h)
                items.append(np.full(len(h), k, np.int64))
                places.append(p)
            else:
                self.items.append(np.zeros(0, np.int32))
                if len(words) >= SHORT_WORDS:
                    self.short.setdefault(tuple(words), []).append(k)
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.slack = self.sizes // 4 + 4
        self.hashes = np.concatenate([np.zeros(1, np.uint64), _word_hashes(list(self.vocabulary))])
        h = np.concatenate([np.zeros(0, np.uint64), *seeds])
        order = np.argsort(h, kind="stable")
        self.seeds = h[order]
        self.item = np.concatenate([np.zeros(0, np.int64), *items])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *places])[order]
        self.shift = np.uint64(64 - min(26, max(16, (16 * len(h)).bit_length())))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[(self.seeds >> self.shift).astype(np.int64)] = True

    @staticmethod
    def _apart(h: np.ndarray, at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """One item's seeds, of equal ones only those more than ``gap`` places apart: windows reach twice
        as far around a hit, so that a repetitive item has a bounded number of places per seed."""
        order = np.lexsort((at, h))
        h, at = h[order], at[order]
        keep = np.ones(len(h), bool)
        last = 0
        for i in np.flatnonzero(h[1:] == h[:-1]).tolist():
            last = i if h[last] != h[i] else last
            keep[i + 1] = at[i + 1] - at[last] > gap
            last = i + 1 if keep[i + 1] else last
        return h[keep], at[keep]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, diagonal) of all seeds in a document: its place less the item's."""
        known, hashes = ids > 0, self.hashes[ids]
        found = []
        for shape, h in zip(SHAPES, _grams(hashes), strict=True):
            whole = np.logical_and.reduce([known[k : k + len(h)] for k in shape])
            at = np.flatnonzero(whole)
            h = h[at]
            some = self.seen[(h >> self.shift).astype(np.int64)]
            at, h = at[some], h[some]
            low, high = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
            rows = common.ragged(np.arange(len(self.seeds)), low, high - low)
            found.append((self.item[rows], np.repeat(at, high - low) - self.place[rows]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def windows(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first word, end word) of the passages to align: hits on neighbouring diagonals share one."""
        item, diagonal = self.hits(ids) if len(self.seeds) else (np.zeros(0, np.int64),) * 2
        if not len(item):
            return
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        first = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > self.slack[item[1:]])]))
        last = np.append(first[1:], len(item)) - 1
        item = item[first]
        low = np.maximum(0, diagonal[first] - self.slack[item])
        high = np.minimum(len(ids), diagonal[last] + self.sizes[item] + self.slack[item])
        known = common.starts(ids > 0)
        enough = known[high] - known[low] >= np.minimum(self.sizes[item], MIN_EQUAL)
        for k, a, end in zip(item[enough].tolist(), low[enough].tolist(), high[enough].tolist(), strict=True):
            # a run of many diagonals is taken in windows that overlap by a whole passage
            size, slack = int(self.sizes[k]), int(self.slack[k])
            while end - a > 2 * size + 4 * slack:
                yield k, a, a + 2 * size + 4 * slack
                a += size + 2 * slack
            yield k, a, end


def smith_waterman(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignments of rows of ids side by side: scores, their ends in the passages, and the
    equal words on their paths. Ids under 1 equal nothing; rows are filled up with them."""
    c, m = passages.shape
    places = np.arange(m + 1, dtype=np.int32)
    steps = places * -GAP
    h, equal = np.zeros((2, c, m + 1), np.int32)
    score, end, count = np.zeros((3, c), np.int64)
    rows = np.arange(c)
    known = passages > 0
    for x in items.T:
        same = (passages == x[:, None]) & known
        diagonal = h[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH))
        up = h + np.int32(GAP)
        row = np.maximum(up, 0)
        n = np.where(up > 0, equal, 0)
        better = diagonal >= row[:, 1:]
        n[:, 1:] = np.where(better, np.where(diagonal > 0, equal[:, :-1] + same, 0), n[:, 1:])
        np.maximum(row[:, 1:], diagonal, out=row[:, 1:])
        row += steps  # a gap along the passage costs one step each
        top = np.maximum.accumulate(row, axis=1)
        source = np.maximum.accumulate(np.where(row == top, places, 0), axis=1)
        h, equal = top - steps, np.take_along_axis(n, source, 1)
        k = h.argmax(1)
        now = h[rows, k]
        up = now > score
        score[up], end[up], count[up] = now[up], k[up], equal[rows, k][up]
    return score, end, count


def _side_by_side(arrays: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(arrays), max(map(len, arrays))), np.int32)
    for row, a in zip(out, arrays, strict=True):
        row[: len(a)] = a
    return out


def _aligned(todo: list[tuple[int, int, int, np.ndarray]], block: Block, min_score: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(document, item, share, equal words, first word, end word) of windows that reach the score.
    Only those whose words can reach it are aligned: a match needs that share of the item's words."""
    todo.sort(key=lambda w: (len(block.items[w[1]]), len(w[3])))
    first = 0
    while first < len(todo):
        last, width = first, 0
        while last < len(todo) and (last == first or max(width, len(todo[last][3])) * (last - first + 1) <= CELLS):
            width = max(width, len(todo[last][3]))
            last += 1
        some, first = todo[first:last], last
        items, passages = _side_by_side([block.items[w[1]] for w in some]), _side_by_side([w[3] for w in some])
        size = np.array([len(block.items[w[1]]) for w in some])
        shared = np.zeros(len(some), np.int64)
        for x in items.T:
            shared += ((passages == x[:, None]) & (x > 0)[:, None]).any(1)
        hopeful = np.flatnonzero((shared >= min_score * size) & (shared >= np.minimum(size, MIN_EQUAL)))
        if not len(hopeful):
            continue
        score, end, equal = smith_waterman(items[hopeful], passages[hopeful])
        share = score / (MATCH * size[hopeful])
        for i in np.flatnonzero((share >= min_score) & (equal >= np.minimum(size[hopeful], MIN_EQUAL))).tolist():
            doc, k, a, _ = some[hopeful[i]]
            yield doc, k, float(share[i]), int(equal[i]), a, a + int(end[i])


def find(texts: list[bytes | None], block: Block, min_score: float = MIN_SCORE) -> list[tuple[int, int, float, int, int, int]]:
    """(text number, item index, score share, equal words, first word of the window, end word) of the
    items that the texts leak: of each the best passage, the first of equal ones."""
    best: dict[tuple[int, int], tuple] = {}
    todo = []
    for doc, text in enumerate(texts):
        if not text:
            continue
        words = normal_words(text)
        ids = np.fromiter(map(block.vocabulary.get, words, repeat(0)), np.int32, len(words))
        todo += [(doc, k, a, ids[a:b]) for k, a, b in block.windows(ids)]
        if block.short:
            at = 0
            for piece in _ENDS.split(text):
                part = tuple(normal_words(piece))
                for k in block.short.get(part, ()):
                    best.setdefault((doc, k), (1.0, len(part), at, at + len(part)))
                at += len(part)
    for doc, k, share, equal, a, b in _aligned(todo, block, min_score):
        old = best.get((doc, k))
        if old is None or (-share, a) < (-old[0], old[2]):
            best[doc, k] = (share, equal, a, b)
    return [(*where, *what) for where, what in sorted(best.items())]


def texts_of(benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The different texts of a benchmark: key (SHA-256) and t; null texts are left out."""
    texts = benchmark.select(F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    return texts.select(F.sha2(F.col("t").cast("binary"), 256).alias("key"), "t").groupBy("key").agg(F.first("t").alias("t"))


def seeds(texts: DataFrame, rare_items: int = RARE_ITEMS) -> DataFrame:
    """(key, h, place) of the seeds of ``texts_of``: n-grams counted over the whole benchmark, those in
    at most ``rare_items`` texts and the rarest that begin in each stretch of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "t"):
                for key, text in zip(part.column(0).to_pylist(), common.byte_column(part, "t"), strict=True):
                    words = normal_words(text)
                    if len(words) >= MIN_WORDS:
                        found = list(_grams(_word_hashes(words)))
                        h, at = np.concatenate(found), np.concatenate([np.arange(len(x), dtype=np.int32) for x in found])
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(at)], names=["key", "h", "place"])

    grams = texts.select("key", "t").mapInArrow(run, "key string, h long, place int")
    counted = grams.join(grams.groupBy("h").agg(F.count_distinct("key").alias("n")), "h")
    stretch = Window.partitionBy("key", F.floor(F.col("place") / STRETCH))
    return counted.withColumn("least", F.min("n").over(stretch)).where((F.col("n") <= rare_items) | (F.col("n") == F.col("least"))).select("key", "h", "place")


def blocks(benchmark: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The different texts of the benchmark as indexes over at most about ``block_chars`` characters
    each. The driver holds one block at a time."""
    texts = texts_of(benchmark, text_col)
    chosen = seeds(texts).groupBy("key").agg(F.collect_list(F.struct("h", "place")).alias("s"))
    whole = texts.join(chosen, "key", "left").select("key", "t", F.col("s.h").alias("h"), F.col("s.place").alias("place"))
    items, held = [], 0
    for row in whole.orderBy("key").toLocalIterator():
        if items and held + len(row["t"]) > block_chars:
            yield Block(items)
            items, held = [], 0
        items.append((row["key"], row["t"].encode("utf-8", "replace"), row["h"] or [], row["place"] or []))
        held += len(row["t"])
    yield Block(items)


MATCHES = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("score", pa.float64()), ("n_equal", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())])


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and benchmark item whose best local alignment reaches the score: doc_id,
    item_id, score (share of a full match), n_equal, first_word and end_word of the passage.

    An item under ``MIN_WORDS`` words scores 1 where a sentence or line of the document has its words and no
    others; under ``SHORT_WORDS`` it matches nothing, like null or empty texts and items. Equal
    items are aligned once and reported each; repeated documents give repeated rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in blocks(benchmark, item_text, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in common.slices(batch, "text"):
                    ids = part.column(0).to_pylist()
                    rows = [(ids[i], index.names[k], *more) for i, k, *more in find(common.byte_column(part, "text"), index, min_score)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MATCHES, strict=True)], schema=MATCHES)

        part = source.mapInArrow(run, "doc_id long, key string, score double, n_equal long, first_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.sha2(F.col(item_text).cast("string").cast("binary"), 256).alias("key"))
    out = out.join(items, "key").select("doc_id", "item_id", "score", "n_equal", "first_word", "end_word")
    return out.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, with all their columns."""
    spark = docs.sparkSession
    common.small_batches(spark)
    for block in blocks(benchmark, block_chars=block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in common.slices(batch, text_col):
                    leaks = {i for i, *_ in find(common.byte_column(part, text_col), index, min_score)}
                    yield part.filter(pa.array([i not in leaks for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
