"""Operator 13, cross-tokenizer alignment by lockstep vectorised merging.

Every text is encoded by a byte-level BPE (A, over a space and the text) and by a piece BPE with byte
fallback (B, which adds the space itself). Both token sequences then cover the same bytes. One NumPy
state vector holds the A and B pointers of all documents of a batch; every step compares the two end
offsets of each, emits a link and a cut where they are equal, advances the pointers that lie behind
and drops the documents that are done. A long document takes several places in the vector (lanes),
one for every ``LANE`` bytes, so that no document makes the others wait.

Counts of linked id pairs are corpus-wide: documents are aligned in blocks of ``BLOCK`` bytes of text
whose distinct pairs are counted in the task; blocks, not documents, meet the corpus counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LANE = 2048
#: Bytes of text of a block; a longer document is a block of its own.
BLOCK = 8 << 20
PIECE_BITS = 17
#: A text splits at single spaces between other characters. Neither vocabulary has a token across
#: such a place: A's words take the space in front, and no piece of B has its space mark after
#: another character.
SPLIT = re.compile(r"(?<=\S) (?=\S)")
#: Letters and marks up to here are classed alike by both engines that can read A's merges.
PLAIN = "ɏ"


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public vocabulary file: in ``folder``, else where the installed package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the other ones follow from code point 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both vocabularies of a worker, their token bytes, and a memo of what words encode to."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            held = json.load(f)
        special = {x["content"] for x in held["added_tokens"]}
        alphabet = byte_alphabet()
        vocab = held["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.a_size = max(vocab.values()) + 1
        self.a_bytes = np.zeros(self.a_size, np.int64)
        for t, i in ranks.items():
            self.a_bytes[i] = len(t)
        # Ids follow the merges, so the id order gives them to the faster engine as ranks.
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_text = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_bytes = np.array([len(x) for x in self.b_text], np.int64)
        self.words = common.WordTable(self.describe, 2, np.int64, limit=400_000)

    def encode_a(self, text: str) -> list[int]:
        if text and (text.isascii() or max(text) <= PLAIN):
            return self.fast(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def describe(self, words: list[bytes]) -> tuple[list, np.ndarray]:
        """Per word: ids of A and then of B; number of A's, and whether B gives back the bytes."""
        texts = [w.decode() for w in words]
        ids, columns = [], np.zeros((len(words), 2), np.int64)
        piece = self.b_text.__getitem__
        for i, (w, t, b) in enumerate(zip(words, texts, self.b.encode(texts, num_threads=1), strict=True)):
            a = self.encode_a(" " + t)
            columns[i] = len(a), b"".join(map(piece, b)) == b" " + w
            ids.append(a + b)
        return ids, columns

    def batch(self, texts: list[str | None]) -> Tokens:
        """Both token sequences of all texts, end to end. Texts without tokens have none in either."""
        split = [SPLIT.split(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        rows = self.words.lookup([w.encode() for ws in split for w in ws])
        doc = np.repeat(np.arange(len(texts)), counts)
        good = np.ones(len(texts), bool)
        good[doc[self.words.columns[rows, 1] == 0]] = False
        rows, doc = rows[good[doc]], doc[good[doc]]
        n = self.words.lengths[rows].astype(np.int64)
        n_a = self.words.columns[rows, 0]
        at = self.words.offsets[rows]
        a, b = (common.ragged(self.words.flat, o, k) for o, k in ((at, n_a), (at + n_a, n - n_a)))
        per_a, per_b = (np.bincount(doc, weights=k, minlength=len(texts)).astype(np.int64) for k in (n_a, n - n_a))
        return Tokens(a, b, per_a, per_b, np.cumsum(self.a_bytes[a]), np.cumsum(self.b_bytes[b]))


class Tokens(NamedTuple):
    """Tokens of several documents: ids, tokens per document, and running end offsets over all bytes."""

    a: np.ndarray
    b: np.ndarray
    per_a: np.ndarray
    per_b: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray


def encoders(a_path: str, b_path: str) -> Encoders:
    return common.memo(("crosstok", a_path, b_path), lambda: Encoders(a_path, b_path))


def lockstep(end_a: np.ndarray, end_b: np.ndarray, starts: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in A, in B) of all tokens that end at the same byte, in order.

    ``end_a`` and ``end_b`` are strictly increasing end offsets over documents that begin at
    ``starts`` (with the total at the end). Lanes are the documents, cut every ``lane`` bytes.
    """
    sizes = np.diff(starts)
    n = -(-sizes // lane)
    low = np.repeat(starts[:-1], n) + lane * (np.arange(n.sum()) - np.repeat(common.starts(n)[:-1], n))
    high = np.minimum(low + lane, np.repeat(starts[1:], n))
    pa_, stop_a = np.searchsorted(end_a, low, "right"), np.searchsorted(end_a, high, "right")
    pb_, stop_b = np.searchsorted(end_b, low, "right"), np.searchsorted(end_b, high, "right")
    links_a: list[np.ndarray] = [np.zeros(0, np.int64)]
    links_b: list[np.ndarray] = [np.zeros(0, np.int64)]
    while True:
        alive = (pa_ < stop_a) & (pb_ < stop_b)
        if not alive.all():
            pa_, pb_, stop_a, stop_b = (x[alive] for x in (pa_, pb_, stop_a, stop_b))
        if not len(pa_):
            break
        ea, eb = end_a[pa_], end_b[pb_]
        cut = ea == eb
        if cut.any():
            links_a.append(pa_[cut])
            links_b.append(pb_[cut])
        pa_ = pa_ + (ea <= eb)
        pb_ = pb_ + (eb <= ea)
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


@lru_cache(maxsize=4)
def _printed(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal ids, each followed by one of ``,|;``, as one byte string with offsets and lengths."""
    texts = [b"%d%c" % (i, s) for i in range(size) for s in b",|;"]
    lengths = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), common.starts(lengths)[:-1], lengths


def group_texts(t: Tokens, cut_a: np.ndarray, cut_b: np.ndarray, size: int) -> tuple[bytes, np.ndarray]:
    """The groups of all documents as ``a1,a2|b1;a3|b2,b3;`` in one byte string, and the place after
    every document."""
    na, nb = len(t.a), len(t.b)
    group_a, group_b = np.searchsorted(cut_a, np.arange(na)), np.searchsorted(cut_b, np.arange(nb))
    before_b = np.concatenate(([0], cut_b + 1))[group_a]  # B tokens of earlier groups
    upto_a = (cut_a + 1)[group_b]
    code = np.zeros(na + nb, np.int64)
    sep = np.zeros(na, np.int64)
    sep[cut_a] = 1
    code[np.arange(na) + before_b] = 3 * t.a.astype(np.int64) + sep
    sep = np.zeros(nb, np.int64)
    sep[cut_b] = 2
    code[np.arange(nb) + upto_a] = 3 * t.b.astype(np.int64) + sep
    values, offsets, lengths = _printed(size)
    n = lengths[code]
    ends = common.starts(n)[common.starts(t.per_a + t.per_b)]
    return common.ragged(values, offsets[code], n).tobytes(), ends


class Aligned(NamedTuple):
    """A batch of aligned texts: tokens, links (positions in A and B) and links per document."""

    tokens: Tokens
    link_a: np.ndarray
    link_b: np.ndarray
    per_link: np.ndarray


def align_texts(texts: list[str | None], enc: Encoders) -> Aligned:
    t = enc.batch(texts)
    ends = np.concatenate(([0], t.end_a))[common.starts(t.per_a)]
    la, lb = lockstep(t.end_a, t.end_b, ends)
    per = np.diff(np.searchsorted(la, common.starts(t.per_a)))
    return Aligned(t, la, lb, per)


def _texts(part: pa.RecordBatch) -> list[str | None]:
    return part.column(1).to_pylist()


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document its token ids in both vocabularies and the cuts: ``id_col``, a_ids, b_ids, a_cuts,
    b_cuts (tokens up to each byte offset where both end; the k-th cuts belong together).

    Null and empty texts, and texts that B does not give back byte by byte, have empty arrays. Rows
    are kept as they come, repeated ids too; other columns are ignored.
    """
    a_path, b_path = a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(a_path, b_path)
        for batch in batches:
            for part in common.slices(batch, "text"):
                x = align_texts(_texts(part), enc)
                t = x.tokens
                at_a, at_b, at_l = (common.starts(p) for p in (t.per_a, t.per_b, x.per_link))
                lists = [(at_a, t.a), (at_b, t.b), (at_l, x.link_a + 1 - np.repeat(at_a[:-1], x.per_link)), (at_l, x.link_b + 1 - np.repeat(at_b[:-1], x.per_link))]
                arrays = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v.astype(np.int32))) for o, v in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return source.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>").withColumnRenamed("doc_id", id_col)


#: A document (its link codes point into its block's pairs) or, without sha, its block's pairs.
PART = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string()), ("codes", pa.binary()), ("counts", pa.binary())])
PART_DDL = "block long, doc_id long, n_a long, n_b long, n_links long, sha string, codes binary, counts binary"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class _Block:
    """Documents of a block with the pairs of their links."""

    def __init__(self, number: int) -> None:
        self.number, self.bytes = number, 0
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.per: list[np.ndarray] = []

    def add(self, ids: list[int | None], x: Aligned, size: int) -> None:
        t = x.tokens
        text, ends = group_texts(t, x.link_a, x.link_b, size)
        at = ends.tolist()
        for doc, na, nb, nl, s, e in zip(ids, t.per_a.tolist(), t.per_b.tolist(), x.per_link.tolist(), at[:-1], at[1:], strict=True):
            self.rows.append((doc, na, nb, nl, hashlib.sha256(text[s : e - 1]).hexdigest() if nl else ""))
        self.pairs.append(t.a[x.link_a].astype(np.int64) << PIECE_BITS | t.b[x.link_b])
        self.per.append(x.per_link)

    def batches(self) -> Iterator[pa.RecordBatch]:
        pairs, code, n = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        at = common.starts(np.concatenate(self.per))
        codes, counts = [], []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own, times = np.unique(code[s:e], return_counts=True)
            codes.append(np.diff(own, prepend=0).astype("<u4").tobytes())
            counts.append(times.astype("<u4").tobytes())
        for k in range(0, len(self.rows), 4096):
            rows = self.rows[k : k + 4096]
            columns = [[self.number] * len(rows), *zip(*rows, strict=True), codes[k : k + 4096], counts[k : k + 4096]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PART, strict=True)], schema=PART)
        last = [[self.number], [None], [None], [None], [len(pairs)], [None], [pairs.astype("<i8").tobytes()], [n.astype("<i8").tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(last, PART, strict=True)], schema=PART)


def _align_blocks(a_path: str, b_path: str, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(a_path, b_path)
        size = max(enc.a_size, len(enc.b_text))
        first = TaskContext.get().partitionId() << 32
        held: _Block | None = None
        for batch in batches:
            for part in common.slices(batch, "text", min(2 << 20, block)):
                if held is None:
                    held = _Block(first)
                x = align_texts(_texts(part), enc)
                held.add(part.column(0).to_pylist(), x, size)
                held.bytes += part.column(1).nbytes
                if held.bytes >= block:
                    yield from held.batches()
                    first, held = first + 1, None
        if held:
            yield from held.batches()
    return run


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks' pairs as rows."""
    for batch in batches:
        for number, pairs, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            pair, n = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<i8")
            for k in range(0, len(pair), 1 << 16):
                cut = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair[cut]), number)), pa.array(pair[cut]), pa.array(n[cut])], names=["block", "pair", "n"])


def _score(key, parts: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of a block with sums over its pairs' corpus counts."""
    pair = np.asarray(known.column("pair"))
    order = np.argsort(pair)
    total, best = np.asarray(known.column("total"))[order], np.asarray(known.column("best"))[order]
    columns = [parts.column(i).to_pylist() for i in range(1, 8)]
    n_best, count_sum = [], []
    for codes, counts in zip(columns[5], columns[6], strict=True):
        own, times = np.cumsum(np.frombuffer(codes, "<u4").astype(np.int64)), np.frombuffer(counts, "<u4").astype(np.int64)
        n_best.append(int(times[best[own]].sum()))
        count_sum.append(int((times * total[own]).sum()))
    doc, na, nb, nl, sha = columns[:5]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((doc, na, nb, nl, nl, n_best, count_sum, sha), RESULT, strict=True)], schema=RESULT)


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Per document: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens are never empty, so a byte offset where both end is one link and ends one group. n_best
    counts the links whose id pair is linked as often in the corpus as any pair of its B id (ties
    included), count_sum adds up the links' corpus counts. Documents without tokens (null, empty, or
    not given back by B) have zeros and an empty digest; repeated ids and rows are documents of their
    own; other columns are ignored; an empty table gives no rows.

    The aligned documents are written once to the shared checkpoint folder, with their links as codes
    of their block's pairs. A pair has one row per block, so the pairs that most texts hold meet
    the corpus counts as often as there are blocks; a block's documents then meet its pairs.
    """
    spark = docs.sparkSession
    a_path, b_path = a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    path = common.scratch(spark, "aligned")
    source.mapInArrow(_align_blocks(a_path, b_path, block), PART_DDL).write.parquet(path)
    parts = spark.read.schema(PART_DDL).parquet(path)
    pairs = parts.where(F.col("sha").isNull()).select("block", "codes", "counts").mapInArrow(_block_pairs, "block long, pair long, n long")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    piece = F.col("pair").bitwiseAND((1 << PIECE_BITS) - 1)
    # One row per id of B: bounded by its vocabulary.
    top = counts.groupBy(piece.alias("piece")).agg(F.max("total").alias("top"))
    judged = counts.withColumn("piece", piece).join(F.broadcast(top), "piece").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    known = pairs.select("block", "pair").join(judged, "pair")
    scored = parts.where(F.col("sha").isNotNull()).groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score, RESULT_DDL)
    return scored.withColumnRenamed("doc_id", id_col)
