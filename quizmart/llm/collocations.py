"""Operator 11, phrase collocations by weighted acyclic automata.

A task counts the phrases of up to four words of a shard of text and writes them, sorted, as a count
automaton: a trie over words in preorder whose entries hold (depth, label, count); the first label
of every path is the language. The shards' automata are cut at the bounds of prefix ranges; a range
adds up all its cuts, keeps what is frequent, and builds its count transducer from the sorted
phrases, one after another, sharing equal endings. The parts that candidates are scored by are
looked up by composing the parts asked of a range, sorted, with its transducer.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import input_partitions
from . import common

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
#: Part of a phrase's occurrences that a longer phrase must have to replace it.
COVER = (80, 100)
SCALE = 2_000_000
#: Bytes of text of a shard (at least one document).
SHARD = 6 << 20
#: Input bytes per prefix range.
RANGE = 3 << 20
#: Entries that a range gathers before it adds them up, and that a shard sends at a time.
GATHER = 1 << 20
SEND = 1 << 18
#: A text gives one sample of the phrases, to set the bounds, per so many characters on average.
SAMPLE_CHARS = 1 << 15
NO_LANG = "und"
#: Every byte that ends a piece becomes this one, which UTF-8 text never has.
MARK = b"\xff"
_PIECES = bytes(MARK[0] if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256))

Phrase = tuple[bytes, ...]


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with ``MARK`` between pieces and at the end."""
    return (text.translate(_PIECES).lower().replace(MARK, b" \xff ") + b" \xff").split()


class Automaton(NamedTuple):
    """Counted phrases as a trie in preorder. ``words`` are sorted, so entries are too; an entry of
    count 0 only leads to others."""

    words: list[bytes]
    depth: np.ndarray
    label: np.ndarray
    count: np.ndarray

    def phrases(self) -> Iterator[tuple[Phrase, int]]:
        """All paths with their counts, in order."""
        path: list[bytes] = []
        for d, w, n in zip(self.depth.tolist(), self.label.tolist(), self.count.tolist(), strict=True):
            del path[d:]
            path.append(self.words[w])
            yield tuple(path), n


class _Layer(NamedTuple):
    """The entries of one depth, sorted: parent's number in the layer above, label, count."""

    parent: np.ndarray
    label: np.ndarray
    count: np.ndarray


def _preorder(words: list[bytes], layers: list[_Layer]) -> Automaton:
    below = [np.ones(len(x.label), np.int64) for x in layers]
    for d in range(len(layers) - 1, 0, -1):
        below[d - 1] += np.bincount(layers[d].parent, weights=below[d], minlength=len(below[d - 1])).astype(np.int64)
    at: list[np.ndarray] = []
    for d, x in enumerate(layers):
        before = common.starts(below[d])[:-1]
        if d:
            first = np.searchsorted(x.parent, np.arange(len(layers[d - 1].label)))
            before = before - np.append(before, 0)[first][x.parent] + at[d - 1][x.parent] + 1
        at.append(before)
    size = sum(len(x.label) for x in layers)
    depth, label, count = np.zeros(size, np.uint8), np.zeros(size, np.int32), np.zeros(size, np.int64)
    for d, (x, where) in enumerate(zip(layers, at, strict=True)):
        depth[where], label[where], count[where] = d, x.label, x.count
    return Automaton(words, depth, label, count)


def _layer(parent: np.ndarray, label: np.ndarray, count: np.ndarray | None, width: int) -> tuple[_Layer, np.ndarray]:
    """Adds up equal (parent, label); also the number of every input's entry."""
    key, inverse, times = np.unique(parent.astype(np.int64) * width + label, return_inverse=True, return_counts=True)
    if count is not None:
        times = np.zeros(len(key), np.int64)
        np.add.at(times, inverse, count)
    return _Layer((key // width).astype(np.int32), (key % width).astype(np.int32), times), inverse


class Shard:
    """Collects the words of texts and gives their count automaton."""

    def __init__(self, longest: int = LONGEST) -> None:
        self.longest, self.bytes = longest, 0
        self.index = common._Index()
        self.ids: list[np.ndarray] = []
        self.langs: list[np.ndarray] = []
        self.index[MARK]  # number 0

    def add(self, text: bytes, lang: bytes) -> None:
        found = tokens(text)
        self.ids.append(np.fromiter(map(self.index.__getitem__, found), np.int32, len(found)))
        self.langs.append(np.full(len(found), self.index[lang], np.int32))
        self.bytes += len(text)

    def automaton(self) -> Automaton:
        order = sorted(self.index)
        place = np.zeros(len(order), np.int64)
        place[[self.index[w] for w in order]] = np.arange(len(order))
        ids, langs = place[np.concatenate(self.ids)], place[np.concatenate(self.langs)]
        mark, width = place[0], len(order)
        word = ids != mark
        at = np.flatnonzero(word)
        ends = np.append(np.flatnonzero(~word), len(ids))
        room = (ends[np.searchsorted(ends, at)] - at).astype(np.int64)  # words up to the piece's end
        layer, rank = _layer(np.zeros(len(at), np.int64), langs[at], None, width)
        layers = [layer]
        for k in range(self.longest):
            if k:
                fits = room > k
                at, room, rank = at[fits], room[fits], rank[fits]
            layer, rank = _layer(rank, ids[at + k], None, width)
            layers.append(layer)
        return _preorder(order, layers)


def _parents(depth: np.ndarray) -> np.ndarray:
    """The place of every entry's parent (itself at depth 0)."""
    places = np.arange(len(depth), dtype=np.int32)
    parent = places.copy()
    for d in range(1, int(depth.max(initial=0)) + 1):
        above = np.maximum.accumulate(np.where(depth == d - 1, places, -1))
        parent[depth == d] = above[depth == d]
    return parent


def union(automata: list[Automaton]) -> Automaton:
    """One automaton with the sums of all counts."""
    if len(automata) == 1:
        return automata[0]
    words = sorted(set().union(*(a.words for a in automata)))
    place = {w: i for i, w in enumerate(words)}
    label = np.concatenate([np.fromiter(map(place.__getitem__, a.words), np.int32, len(a.words))[a.label] for a in automata])
    depth, count = np.concatenate([a.depth for a in automata]), np.concatenate([a.count for a in automata])
    parent = _parents(depth)
    rank = np.zeros(len(depth), np.int32)
    layers = []
    for d in range(int(depth.max(initial=0)) + 1):
        at = np.flatnonzero(depth == d)
        layer, rank[at] = _layer(rank[parent[at]] if d else np.zeros(len(at), np.int64), label[at], count[at], len(words))
        layers.append(layer)
    return _preorder(words, layers)


def _search(a: Automaton, parent: np.ndarray, bounds: list[Phrase]) -> list[int]:
    """The place of the first entry that is not below each bound."""
    out = []
    by_depth = [np.flatnonzero(a.depth == d) for d in range(int(a.depth.max(initial=0)) + 1)]
    for bound in bounds:
        lo, hi, place = 0, len(a.depth), 0  # entries that start with the bound's first words
        for d, w in enumerate(bound):
            k = bisect_left(a.words, w)
            known = k < len(a.words) and a.words[k] == w
            own = by_depth[d][np.searchsorted(by_depth[d], lo) : np.searchsorted(by_depth[d], hi)] if d < len(by_depth) else []
            i = bisect_left(own, k, key=lambda p: int(a.label[p]))
            place = int(own[i]) if i < len(own) else hi
            if not known or i == len(own) or a.label[own[i]] != k:
                break
            lo, hi = place + 1, int(own[i + 1]) if i + 1 < len(own) else hi
        out.append(place)
    return out


def cut(a: Automaton, bounds: list[Phrase]) -> Iterator[tuple[int, Automaton]]:
    """(range, its part of ``a``): entries from a bound up to the next one, below their ancestors
    (which count 0 there). ``words`` are those of the part."""
    parent = _parents(a.depth)
    places = [0, *_search(a, parent, bounds), len(a.depth)]
    for r, (s, e) in enumerate(zip(places[:-1], places[1:], strict=True)):
        if s >= e:
            continue
        above = []
        p = s
        while a.depth[p]:
            p = int(parent[p])
            above.append(p)
        above = np.array(above[::-1], np.int64)
        depth = np.concatenate((a.depth[above], a.depth[s:e]))
        label = np.concatenate((a.label[above], a.label[s:e]))
        count = np.concatenate((np.zeros(len(above), np.int64), a.count[s:e]))
        used, label = np.unique(label, return_inverse=True)
        yield r, Automaton([a.words[i] for i in used.tolist()], depth, label.astype(np.int32), count)


#: An automaton as a row: words end to end with their lengths, and the entries.
PACKED = [("words", pa.binary()), ("sizes", pa.binary()), ("depth", pa.binary()), ("label", pa.binary()), ("count", pa.binary())]
PACKED_DDL = "words binary, sizes binary, depth binary, label binary, count binary"


def pack(a: Automaton) -> tuple[bytes, ...]:
    sizes = np.fromiter(map(len, a.words), "<u4", len(a.words))
    width = "<i4" if a.count.max(initial=0) < 1 << 31 else "<i8"
    return b"".join(a.words), sizes.tobytes(), a.depth.tobytes(), a.label.astype("<i4").tobytes(), a.count.astype(width).tobytes()


def unpack(row: Iterable[bytes]) -> Automaton:
    words, sizes, depth, label, count = row
    ends = np.cumsum(np.frombuffer(sizes, "<u4")).tolist()
    return Automaton([words[s:e] for s, e in zip([0, *ends], ends, strict=False)], np.frombuffer(depth, np.uint8), np.frombuffer(label, "<i4"), np.frombuffer(count, "<i4" if len(count) == 4 * len(depth) else "<i8"))


class Transducer:
    """Minimal acyclic transducer from phrases to counts, built from sorted phrases.

    A state is (count, labels, targets); the states of the last phrase's path stay open until the
    next one parts from it, then each is replaced by an equal one, if there is any.
    """

    def __init__(self, phrases: Iterable[tuple[Phrase, int]] = ()) -> None:
        self.states: list[tuple[int, Phrase, tuple[int, ...]]] = []
        self._known: dict[tuple, int] = {}
        self._path: Phrase = ()
        self._open: list[tuple[int, list[bytes], list[int]]] = [(0, [], [])]
        for phrase, n in phrases:
            self.add(phrase, n)
        self.root = self._close(0)

    def _state(self, count: int, labels: list[bytes], targets: list[int]) -> int:
        state = (count, tuple(labels), tuple(targets))
        if state not in self._known:
            self._known[state] = len(self.states)
            self.states.append(state)
        return self._known[state]

    def _close(self, depth: int) -> int:
        while len(self._open) - 1 > depth:
            done = self._state(*self._open.pop())
            self._open[-1][1].append(self._path[len(self._open) - 1])
            self._open[-1][2].append(done)
        return self._state(*self._open[0]) if depth == 0 else -1

    def add(self, phrase: Phrase, count: int) -> None:
        same = 0
        while same < min(len(phrase), len(self._path)) and phrase[same] == self._path[same]:
            same += 1
        while len(self._open) - 1 > same:
            done = self._state(*self._open.pop())
            self._open[-1][1].append(self._path[len(self._open) - 1])
            self._open[-1][2].append(done)
        for _ in phrase[same:]:
            self._open.append((0, [], []))
        _, labels, targets = self._open[-1]
        self._open[-1] = (count, labels, targets)
        self._path = phrase

    def compose(self, phrases: Iterable[Phrase]) -> Iterator[int]:
        """The counts of sorted phrases (0 for one that is not accepted): both are walked together,
        a phrase goes on from where it parts from the one before."""
        path: list[bytes] = []
        at = [self.root]  # states along the path, -1 where it ends
        for phrase in phrases:
            same = 0
            while same < min(len(phrase), len(path)) and phrase[same] == path[same]:
                same += 1
            del path[same:], at[same + 1 :]
            for w in phrase[same:]:
                state = -1
                if at[-1] >= 0:
                    _, labels, targets = self.states[at[-1]]
                    i = bisect_left(labels, w)
                    if i < len(labels) and labels[i] == w:
                        state = targets[i]
                at.append(state)
                path.append(w)
            yield self.states[at[-1]][0] if at[-1] >= 0 else 0


def sub_phrases(phrase: Phrase) -> set[Phrase]:
    """What scoring a candidate (language first) asks for: both parts of every cut, the phrases
    of two or more words within it, and its language."""
    lang, words = phrase[:1], phrase[1:]
    out = {lang + words[:k] for k in range(len(words))} | {lang + words[k:] for k in range(1, len(words))}
    return out | {lang + words[i:j] for i in range(len(words)) for j in range(i + 2, len(words) + 1) if j - i < len(words)}


def best_cut(phrase: Phrase, a: int, counts: dict[Phrase, int], scale: int = SCALE) -> tuple[int, int, int]:
    """(score, l, r) of the lowest-scoring cut, the first of equal ones."""
    lang, words = phrase[:1], phrase[1:]
    scores = []
    for k in range(1, len(words)):
        left, right = counts[lang + words[:k]], counts[lang + words[k:]]
        scores.append((scale * a // (left + right), k, left, right))
    score, _, left, right = min(scores)
    return score, left, right


def _bounds(docs: DataFrame, ranges: int, longest: int) -> list[Phrase]:
    """``ranges`` - 1 phrases that cut the phrases of the corpus into about equal ranges, sampled as a
    range partitioning samples: a text gives the words after a place drawn from its hash, with a
    chance that follows its length. They balance the work and do not touch the result."""
    if ranges < 2:
        return []
    place = F.pmod(F.xxhash64("text"), F.lit(SAMPLE_CHARS)).cast("int")
    times = F.explode(F.sequence(F.lit(0), F.expr(f"length(text) div {SAMPLE_CHARS}")))
    drawn = docs.where(F.length("text") > 0).select("lang", "text", place.alias("__p"), times.alias("__k"))
    at = F.col("__p") + F.col("__k") * SAMPLE_CHARS
    drawn = drawn.where(at < F.length("text")).select("lang", F.substr("text", at + 1, F.lit(200)).alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                found = tokens(text.encode())[1:-1]
                while found and found[0] == MARK:
                    found = found[1:]
                if found:
                    words = found[:longest]
                    rows.append([lang.encode(), *words[: words.index(MARK) if MARK in words else longest]])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.binary()))], names=["phrase"])

    sample = drawn.mapInArrow(run, "phrase array<binary>")
    first = sample.repartitionByRange(ranges, "phrase").sortWithinPartitions("phrase").mapInArrow(_first, "phrase array<binary>")
    return sorted({tuple(bytes(w) for w in r[0]) for r in first.collect()})[1:]  # at most one per range


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = False
    for batch in batches:
        if batch.num_rows and not done:
            done = True
            yield batch.slice(0, 1)


def _shards(bounds: Broadcast, longest: int, shard: int):
    def flush(held: Shard) -> Iterator[pa.RecordBatch]:
        if any(map(len, held.ids)):
            rows, size = [], 0
            for r, part in cut(held.automaton(), bounds.value):
                rows.append((r, *pack(part)))
                size += len(part.depth)
                if size > SEND:
                    yield _rows([("range", pa.int32()), *PACKED], rows)
                    rows, size = [], 0
            if rows:
                yield _rows([("range", pa.int32()), *PACKED], rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shard(longest)
        for batch in batches:
            for text, lang in zip(common.byte_column(batch, "text"), common.byte_column(batch, "lang"), strict=True):
                held.add(text or b"", lang)
                if held.bytes >= shard:
                    yield from flush(held)
                    held = Shard(longest)
        yield from flush(held)
    return run


def _rows(fields: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def frequent(a: Automaton, least: int) -> Automaton:
    """The entries that occur ``least`` times, and all languages. What leads to an entry occurs as
    often at least; where its count lies in another range it is 0 here and kept for the path."""
    parent = _parents(a.depth)
    keep = (a.count >= least) | (a.depth == 0)
    for d in range(int(a.depth.max(initial=0)), 0, -1):
        keep[parent[(a.depth == d) & keep]] = True
    used, label = np.unique(a.label[keep], return_inverse=True)
    return Automaton([a.words[i] for i in used.tolist()], a.depth[keep], label.astype(np.int32), a.count[keep])


def _merge(least: int):
    """Adds up the cuts of a partition's one range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                now, *row = (batch.column(k)[i].as_py() for k in range(6))
                held.append(unpack(row))
                size += len(held[-1].depth)
                if size > GATHER and len(held) > 1 and size > 2 * len(held[0].depth):
                    held = [union(held)]
                    size = len(held[0].depth)
        if held:
            yield _rows([("range", pa.int32()), *PACKED], [(now, *pack(frequent(union(held), least)))])
    return run


PHRASES = pa.list_(pa.list_(pa.binary()))


def _asked(bounds: Broadcast, least: int):
    """Of every range, the parts its candidates need, by the range that counts them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r, *row = (batch.column(k)[i].as_py() for k in range(6))
                need: dict[int, set[Phrase]] = {}
                for phrase, n in unpack(row).phrases():
                    if len(phrase) > 2 and n >= least:
                        for p in sub_phrases(phrase):
                            need.setdefault(bisect_right(bounds.value, p), set()).add(p)
                if need:
                    yield _rows([("range", pa.int32()), ("asks", pa.int32()), ("phrases", PHRASES)], [(to, r, sorted(p)) for to, p in need.items()])
    return run


ANSWERS = pa.schema([("range", pa.int32()), ("phrases", PHRASES), ("counts", pa.list_(pa.int64()))])


def _answer(key, asked: pa.Table, held: pa.Table) -> pa.Table:
    automata = [unpack(row) for row in zip(*(held.column(n).to_pylist() for n, _ in PACKED), strict=True)]
    counts = Transducer((p, n) for a in automata for p, n in a.phrases())
    rows = []
    for to, phrases in zip(asked.column("asks").to_pylist(), asked.column("phrases").to_pylist(), strict=True):
        rows.append((to, phrases, list(counts.compose(tuple(p) for p in phrases))))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ([], [], []), ANSWERS, strict=True)], schema=ANSWERS)


SCORED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("n", pa.int64()), ("score", pa.int64()), ("covers", pa.list_(pa.string()))])


def _score(least: int, cover: tuple[int, int], scale: int):
    def run(key, answers: pa.Table, held: pa.Table) -> pa.Table:
        counts: dict[Phrase, int] = {}
        for phrases, ns in zip(answers.column("phrases").to_pylist(), answers.column("counts").to_pylist(), strict=True):
            counts |= zip(map(tuple, phrases), ns, strict=True)
        rows = []
        for row in zip(*(held.column(n).to_pylist() for n, _ in PACKED), strict=True):
            for phrase, a in unpack(row).phrases():
                if len(phrase) < 3 or a < least:
                    continue
                lang, words = phrase[:1], phrase[1:]
                score, left, right = best_cut(phrase, a, counts, scale)
                inner = {words[i:j] for i in range(len(words)) for j in range(i + 2, len(words) + 1) if j - i < len(words)}
                covers = [b" ".join(p).decode() for p in inner if cover[1] * a >= cover[0] * counts[lang + p]]
                rows.append((lang[0].decode(), b" ".join(words).decode(), a, left, right, counts[lang], score, covers))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 8, SCORED, strict=True)], schema=SCORED)
    return run


def scored_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST,
                   cover: tuple[int, int] = COVER, scale: int = SCALE, ranges: int | None = None, shard: int = SHARD) -> DataFrame:
    """All candidates that no longer one replaces: lang, phrase, a, l, r, n, score (all that occur
    ``min_count`` times, of two to ``longest`` words).

    Null texts are empty, a null language is ``und``; repeated rows count as often as they occur; other
    columns are ignored; an empty table gives no rows. The cuts of the shards are written once to
    the shared checkpoint folder, and so are the ranges' automata.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"))
    ranges = ranges or input_partitions(docs.select(text_col), RANGE)
    bounds = _bounds(source, ranges, longest)
    known = spark.sparkContext.broadcast(bounds)  # one phrase per range, as in any range partitioning
    packed = f"range int, {PACKED_DDL}"
    cuts = source.mapInArrow(_shards(known, longest, shard), packed)
    merged = cuts.repartitionById(len(bounds) + 1, F.col("range")).mapInArrow(_merge(min_count), packed)
    path = common.scratch(spark, "counts")
    merged.write.parquet(path)
    counts = spark.read.schema(packed).parquet(path)
    asked = counts.mapInArrow(_asked(known, min_count), "range int, asks int, phrases array<array<binary>>")
    answers = asked.groupBy("range").cogroup(counts.groupBy("range")).applyInArrow(_answer, "range int, phrases array<array<binary>>, counts array<long>")
    ddl = "lang string, phrase string, a long, l long, r long, n long, score long, covers array<string>"
    path = common.scratch(spark, "candidates")
    answers.groupBy("range").cogroup(counts.groupBy("range")).applyInArrow(_score(min_count, cover, scale), ddl).write.parquet(path)
    found = spark.read.schema(ddl).parquet(path)
    gone = found.select("lang", F.explode("covers").alias("phrase")).distinct()
    return found.drop("covers").join(gone, ["lang", "phrase"], "left_anti")


def top_phrases(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """Each language's first ``top`` phrases by score, a (both descending) and phrase: lang, rank,
    phrase, a, l, r, n, score. The first ones are taken in 64 parts of a language, then of
    those, so that no task sorts a whole language."""
    found = scored_phrases(docs, **options)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = found.withColumn("__part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("rank") <= top)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
