"""Operator 1, quality rules by tokeniser fertility.

Two public vocabularies (byte-level BPE and BPE with byte fallback) encode every word of a text; a
document is judged by its characters per token, the share of byte-fallback tokens and the entropy of
its tokens, against bands of its language, or of its main script where the language has no bands.
The lower band of characters per token is learned: each language has the quartiles of all its
documents, and a text may lie below the fence that they give by a margin that falls with its length.

One pass over the documents; only counts of rounded measures are shuffled. A worker remembers what the words it has met encode
to (a bounded memo), so that the tokenisers only see new words.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root
from . import common

#: Fixed by the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20

#: Rejection bands, inclusive: characters per token (of either vocabulary) from, to; largest share of
#: byte-fallback pieces; least token entropy in bits, of a text long enough to reach it (a shorter
#: one needs half the bits that its number of tokens allows). Keys are ``lang`` values; a text in
#: another or in no language is held to the bands of its main script.
BANDS = {
    "en": (1.2, 7.0, 0.02, 4.0),
    "de": (1.2, 7.0, 0.02, 4.0),
    "fr": (1.2, 7.0, 0.02, 4.0),
    "es": (1.2, 7.0, 0.02, 4.0),
    "latin": (1.1, 7.5, 0.05, 3.8),
    "greek": (0.4, 6.0, 0.10, 3.5),
    "cyrillic": (0.4, 6.0, 0.10, 3.5),
    "hebrew": (0.3, 6.0, 0.15, 3.5),
    "arabic": (0.3, 6.0, 0.15, 3.5),
    "indic": (0.2, 6.0, 0.60, 3.0),
    "cjk": (0.3, 4.0, 0.60, 3.5),
    "other": (0.2, 8.0, 0.60, 3.0),
}

#: Learned bands are of documents with so many tokens, of languages with so many such documents (at
#: most so many languages). The fence is so many interquartile ranges below the lower quartile, and
#: at least that share of the median below the median.
LEARN_TOKENS, LEARN_DOCS, LEARN_LANGS = 100, 30, 1000
FENCE, LEAST_MARGIN = 1.5, 0.05
#: A text of n tokens goes if it is below the fence by more than so many medians over sqrt(n) in either
#: vocabulary, or by the smaller margin in both: a text with one long number or key in it is rare in
#: one vocabulary, mojibake in both. On sf0.1 the clean documents reach 3.6 and 0.95.
EITHER, BOTH = 4.5, 1.5

#: Words that a worker remembers: most of a larger memo are words met once.
WORDS = 300_000

#: The script that a UTF-8 lead byte stands for: first lead byte of each run.
LEADS = [(0xC2, "other"), (0xC3, "latin"), (0xCA, "other"), (0xCD, "greek"), (0xD0, "cyrillic"), (0xD4, "other"), (0xD6, "hebrew"), (0xD8, "arabic"), (0xDC, "other"), (0xE0, "indic"), (0xE1, "other"), (0xE3, "cjk"), (0xEE, "other")]
SCRIPTS = ["latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "cjk", "other"]

MEASURES = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("bands", pa.string()), ("chars_per_token", pa.float64()), ("chars_per_piece", pa.float64()),
    ("fallback_share", pa.float64()), ("token_entropy", pa.float64()), ("reason", pa.string()),
]


def _script_table() -> np.ndarray:
    out = np.zeros((256, len(SCRIPTS)), np.int64)
    letters = [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]
    out[letters, SCRIPTS.index("latin")] = 1
    for (first, script), (end, _) in zip(LEADS, [*LEADS[1:], (0xF8, "")], strict=True):
        out[first:end, SCRIPTS.index(script)] = 1
    return out


SCRIPT_OF_BYTE = _script_table()


def word_table(directory: str) -> common.WordTable:
    return common.memo(("fertility", directory), lambda: _build(directory))


def _build(directory: str) -> common.WordTable:
    """Words with the token ids of the byte-level vocabulary; columns: tokens, pieces of the other
    vocabulary, byte-fallback pieces among them."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(os.path.join(directory, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    tokens = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(directory, "piece_bpe_32k.model"))
    is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])

    def describe(words: list[bytes]):
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = [tokens.encode_ordinary(" " + t) for t in texts]
        cut = pieces.encode(texts, num_threads=1)
        n_pieces = np.fromiter(map(len, cut), np.int64, len(cut))
        at = common.starts(n_pieces)
        fallback = common.starts(is_byte[np.fromiter(chain.from_iterable(cut), np.int64, int(at[-1]))])
        return ids, np.stack((np.fromiter(map(len, ids), np.int64, len(ids)), n_pieces, fallback[at[1:]] - fallback[at[:-1]]), axis=1)

    return common.WordTable(describe, 3, np.int32, limit=WORDS)


#: Odd multipliers that tell the places of a window apart.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the sequence, first occurrences included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    a = ids.astype(np.uint64) + np.uint64(1)
    a ^= a << np.uint64(29)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h += (a[k : k + n] ^ (a[k : k + n] >> np.uint64(31))) * _PLACES[k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    for k in range(window):  # equal hashes count only for equal words
        same &= ids[order[1:] + k] == ids[order[:-1] + k]
    at = np.concatenate((order[1:][same], order[:-1][same]))
    mark = np.zeros(len(ids) + 1, np.int32)
    at = np.unique(at)
    mark[at] += 1
    np.subtract.at(mark, at + window, 1)
    return int((np.cumsum(mark) > 0).sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines of one text."""
    chars = len(text.translate(None, common.SPACE + bytes(range(0x80, 0xC0))))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    dup = 0
    if b"\n" in text:
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        dup = len(lines) - len(set(lines))
    return chars, symbols, dup


def _entropies(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits per token of each document's token histogram; ``counts``: tokens of each document."""
    n = len(counts)
    out = np.zeros(n)
    if not len(ids):
        return out
    key = (np.repeat(np.arange(n, dtype=np.int64), counts) << 20) | ids
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    c = np.diff(np.append(first, len(key))).astype(float)
    sums = np.bincount(key[first] >> 20, weights=c * np.log2(c), minlength=n)
    some = counts > 0
    out[some] = np.log2(counts[some]) - sums[some] / counts[some]
    return np.maximum(out, 0.0)


def unknown(chars: float, per_token: float, per_piece: float, learned: tuple | None) -> bool:
    """Whether a text has too few characters per token for its language; ``learned``: fence and median
    of either vocabulary."""
    if not learned or not per_token or not per_piece:
        return False
    below = [(fence - x) / median * np.sqrt(chars / x) for x, (fence, median) in zip((per_token, per_piece), learned, strict=True)]
    return max(below) > EITHER or min(below) > BOTH


def learn(measured: DataFrame) -> dict[str, tuple]:
    """Fence and median of either vocabulary of every language (``key``) with enough documents."""
    some = measured.where(~F.col("base_failed") & (F.col("word_chars") >= LEARN_TOKENS * F.greatest("chars_per_token", "chars_per_piece")))
    quarters = [F.percentile(F.round(c, 3), [0.25, 0.5, 0.75]).alias(c) for c in ("chars_per_token", "chars_per_piece")]
    rows = some.groupBy("key").agg(F.count("*").alias("n"), *quarters).where(F.col("n") >= LEARN_DOCS).orderBy(F.desc("n"), "key").limit(LEARN_LANGS).collect()
    return {r["key"]: tuple((min(a - FENCE * (c - a), b * (1 - LEAST_MARGIN)), b) for a, b, c in (r["chars_per_token"], r["chars_per_piece"])) for r in rows}


def measure(texts: list[bytes | None], langs: list[str | None], directory: str, bands: dict, learned: dict | None = None) -> dict[str, list]:
    """The measures and the verdict of each text; a null text has no words. ``learned``: bands by
    language, or by script for a text of no language."""
    table = word_table(directory)
    texts = [t or b"" for t in texts]
    split = [t.split() for t in texts]
    at = common.starts(np.fromiter(map(len, split), np.int64, len(split)))
    ids = table.lookup([w for words in split for w in words])
    columns = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(table.columns[ids], axis=0, dtype=np.int64)))
    sums = columns[at[1:]] - columns[at[:-1]]
    entropy = _entropies(common.ragged(table.flat, table.offsets[ids], table.lengths[ids]).astype(np.int64), sums[:, 0])
    out: dict[str, list] = {k: [] for k, _ in MEASURES}
    for i, t in enumerate(texts):
        n = int(at[i + 1] - at[i])
        chars, symbols, dup = base_counts(t, split[i])
        repeat = repeat_words(ids[at[i] : at[i + 1]])
        failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
        band = langs[i] if langs[i] in bands else None
        if band is None:
            letters = np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ SCRIPT_OF_BYTE
            band = SCRIPTS[int(letters.argmax())] if letters.any() else "other"
        low, high, most, least = bands[band]
        tokens, pieces, fallback = (int(x) for x in sums[i])
        per_token, per_piece = (chars / tokens if tokens else 0.0), (chars / pieces if pieces else 0.0)
        share = fallback / pieces if pieces else 0.0
        floor = min(least, 0.5 * np.log2(tokens)) if tokens > 1 else 0.0
        reason = None
        if failed:
            reason = "few_words" if n < MIN_WORDS else "repeated_windows"
        elif not (low <= per_token <= high and low <= per_piece <= high):
            reason = "chars_per_token"
        elif learned and unknown(chars, per_token, per_piece, learned.get(langs[i] or band)):
            reason = "chars_per_token"
        elif share > most:
            reason = "byte_fallback"
        elif entropy[i] < floor:
            reason = "token_entropy"
        for k, v in zip(out, (n, chars, symbols, dup, repeat, failed, reason is None, band, per_token, per_piece, share, float(entropy[i]), reason), strict=True):
            out[k].append(v)
    return out


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, bands string, chars_per_token double, chars_per_piece double, fallback_share double, token_entropy double, reason string"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", directory: str = common.TOKENIZER_DIR, bands: dict | None = None) -> DataFrame:
    """One row per document: ``id_col``, the base counts, the fertility measures and ``kept``.

    A null or empty text has no words and fails the base rule. A null ``lang`` (or a frame without
    that column: ``lang_col=None``) falls back to the main script. Null ids and repeated rows stay as
    they are. Other columns are ignored. An empty table gives no rows. The documents are measured once;
    the measures are checkpointed for the learned bands.
    """
    checkpoint_root(docs.sparkSession)
    common.small_batches(docs.sparkSession)
    bands = bands or BANDS
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), *MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", common.WORDS_BYTES):
                langs = part.column(2).to_pylist()
                found = measure(common.byte_column(part, "text"), langs, directory, bands)
                keys = [k or b for k, b in zip(langs, found["bands"], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.string()), *(pa.array(found[k], t) for k, t in MEASURES)], schema=schema)

    measured = source.mapInArrow(run, f"doc_id long, key string, {FIELDS}").checkpoint()
    learned = learn(measured)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("key", "word_chars", "chars_per_token", "chars_per_piece", "base_failed")), strict=True)
            # the order of the rules in measure(): the base rule, characters per token, the others
            low = [not failed and unknown(chars, per_token, per_piece, learned.get(key)) for key, chars, per_token, per_piece, failed in rows]
            out = {k: batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", *(k for k, _ in MEASURES))}
            out["kept"] = pa.array([k and not x for k, x in zip(out["kept"].to_pylist(), low, strict=True)], pa.bool_())
            out["reason"] = pa.array(["chars_per_token" if x else r for r, x in zip(out["reason"].to_pylist(), low, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return measured.mapInArrow(judge, f"doc_id long, {FIELDS}").withColumnRenamed("doc_id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", directory: str = common.TOKENIZER_DIR, bands: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns. The texts are
    read twice, for the learned bands and for the rows, and written nowhere."""
    common.small_batches(docs.sparkSession)
    bands = bands or BANDS
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    source = docs.select(F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    wanted = {k: t for k, t in MEASURES if k in ("base_failed", "word_chars", "chars_per_token", "chars_per_piece")}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", common.WORDS_BYTES):
                langs = part.column(1).to_pylist()
                found = measure(common.byte_column(part, "text"), langs, directory, bands)
                keys = [k or b for k, b in zip(langs, found["bands"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(found[k], t) for k, t in wanted.items())], names=["key", *wanted])

    learned = learn(source.mapInArrow(look, "key string, word_chars long, base_failed boolean, chars_per_token double, chars_per_piece double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, text_col, common.WORDS_BYTES):
                langs = part.column(part.schema.get_field_index(lang_col)).to_pylist() if lang_col else [None] * part.num_rows
                yield part.filter(pa.array(measure(common.byte_column(part, text_col), langs, directory, bands, learned)["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
