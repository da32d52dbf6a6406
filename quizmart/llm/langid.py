"""Operator 5, language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords (letter n-grams of its words, hashed into
buckets); a linear layer and a softmax give the languages. Embeddings and layer are trained together
by stochastic gradient descent in numpy on a bounded sample of labelled rows, whose subwords are
counted by the executors: the driver gets at most BUCKETS counts a row, however long its text. Part of
the sample is kept back to fit the softmax temperature and the score under which a prediction is rejected.

Since the layer is linear, what a word adds to the logits is a fixed vector: prediction is one pass
that sums remembered word vectors over whole texts.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of each language that training reads at most.
SAMPLE_PER_LANG = 1000
BUCKETS, WIDTH = 1 << 16, 16
GRAMS = (2, 3, 4)
EPOCHS, RATE = 4, 0.5
#: Every so-many-th sampled row calibrates instead of training.
CALIBRATE_EVERY = 5
#: Share of right answers that accepted predictions shall reach on the calibration rows.
TARGET = 0.995

#: Runs of letters, with number signs like U+00B2 or U+2167 among them, which are taken out.
LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(word: str) -> list[str]:
    if word.isalpha():
        return [word]
    return [run for part in LETTERS.findall(word) for run in ([part] if part.isalpha() else "".join(c if c.isalpha() else " " for c in part).split())]


def subwords(word: str) -> list[int]:
    """Buckets of the letter n-grams of a word's lower-cased letter runs, with the run's ends marked."""
    out = []
    for run in letter_runs(word.lower()):
        marked = f"<{run}>"
        for n in GRAMS:
            out += [zlib.crc32(marked[i : i + n].encode()) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


class Model:
    """languages, embeddings [BUCKETS, WIDTH], layer [WIDTH, n], bias [n], temperature, least score."""

    def __init__(self, languages: list[str], embeddings: np.ndarray, layer: np.ndarray, bias: np.ndarray) -> None:
        self.languages, self.embeddings, self.layer, self.bias = languages, embeddings, layer, bias
        self.temperature, self.least_score = 1.0, 0.0

    def logits(self, mean: np.ndarray) -> np.ndarray:
        return mean @ self.layer + self.bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def count_subwords(text: str, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's subwords in order and how often each occurs; ``known`` remembers words."""
    counts: Counter = Counter()
    for word, n in Counter(text.split()).items():
        if word not in known:
            known[word] = subwords(word)
        for b in known[word]:
            counts[b] += n
    at = np.array(sorted(counts), np.int32)
    return at, np.array([counts[b] for b in at.tolist()], np.int64)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Trains on (text, language) rows, see ``fit_counts``."""
    known: dict[str, list[int]] = {}
    return fit_counts([(lang, *count_subwords(text, known)) for text, lang in rows], seed)


def fit_counts(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Trains on (language, buckets, counts) rows. With fewer than two languages every text gets the
    one there is (no rows: ``und``)."""
    languages = sorted({lang for lang, _, _ in rows})
    rows = [r for r in rows if len(r[1])]
    features = [(at, n.astype(np.float32) / np.float32(n.sum())) for _, at, n in rows]
    targets = [languages.index(lang) for lang, _, _ in rows]
    rng = np.random.default_rng(seed)
    n = max(1, len(languages))
    model = Model(languages or ["und"], rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.3, (WIDTH, n)).astype(np.float32), np.zeros(n, np.float32))
    if len(languages) < 2 or not features:
        return model
    kept_back = np.arange(len(features)) % CALIBRATE_EVERY == 0
    train = np.flatnonzero(~kept_back)
    if not len(train):
        train = np.arange(len(features))
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train).tolist():
            rate = RATE * (1 - done / steps)
            done += 1
            at, weight = features[i]
            mean = weight @ model.embeddings[at]
            error = _softmax(model.logits(mean))
            error[targets[i]] -= 1
            back = model.layer @ error
            model.layer -= rate * np.outer(mean, error)
            model.bias -= rate * error
            # a bucket's share of the mean is small, so its step is scaled by the number of buckets
            model.embeddings[at] -= rate * len(at) ** 0.5 * weight[:, None] * back[None, :]
    held = np.flatnonzero(kept_back)
    logits = np.array([model.logits(features[i][1] @ model.embeddings[features[i][0]]) for i in held.tolist()])
    right = np.array([targets[i] for i in held.tolist()])
    grid = np.geomspace(0.05, 20, 61)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(right)), right], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    scores = _softmax(logits / model.temperature)
    top, hit = scores.max(axis=1), scores.argmax(axis=1) == right
    order = np.argsort(-top)
    share = np.cumsum(hit[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= TARGET)
    model.least_score = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fits a model on at most ``per_lang`` rows of each language: those with the smallest hashes of
    ``order_col``. Rows with a null text or language are not used."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(order_col)).alias("h")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():  # a tenth more than wanted, so that the cut below decides
        share = F.when(F.col("lang") == lang, min(1.0, 1.1 * per_lang / n)).otherwise(share)
    unit = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                known: dict[str, list[int]] = {}
                found = [count_subwords(t.decode("utf-8", "replace"), known) for t in common.byte_column(part, "text")]
                packed = [pa.array([f[k].astype(np.uint32).tobytes() for f in found], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *packed], names=["lang", "h", "at", "n"])

    counted = rows.where(unit < share).mapInArrow(count, "lang string, h long, at binary, n binary")
    sample = sorted((r["lang"], r["h"] % (1 << 30), r["h"], bytes(r["at"]), bytes(r["n"])) for r in counted.collect())
    taken: Counter = Counter()
    out = []
    for lang, _, _, at, n in sample:
        if taken[lang] < per_lang:
            taken[lang] += 1
            out.append((lang, np.frombuffer(at, np.uint32), np.frombuffer(n, np.uint32)))
    return fit_counts(out)


def _word_table(name: str, blob: bytes) -> common.WordTable:
    """The worker's memo of word vectors (logit sums, subwords, letters) for one model."""

    def build() -> common.WordTable:
        model: Model = pickle.loads(blob)
        vectors = (model.embeddings @ model.layer).astype(np.float64)

        def describe(words: list[bytes]):
            out = np.zeros((len(words), len(model.languages) + 1))
            for i, w in enumerate(words):
                at = subwords(w.decode("utf-8", "replace"))
                if at:
                    out[i, :-1] = vectors[at].sum(axis=0)
                    out[i, -1] = len(at)
            return [()] * len(words), out

        table = common.WordTable(describe, len(model.languages) + 1, np.float64)
        table.model = model
        return table

    return common.memo(("langid", name), build)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: doc_id) and lang_pred, score (calibrated, 0 to 1), rejected
    (score under the calibrated least score), for every row.

    A null text or one without letters is ``und`` with score 0 and rejected; rows may repeat; other
    columns are ignored. An empty table gives no rows.
    """
    blob = pickle.dumps(model)
    name = hashlib.sha256(blob).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(blob)  # BUCKETS x WIDTH floats: fixed size
    keep = keep or ["doc_id"]
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    kept = source.schema.fields[:-1]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "lang_pred string, score double, rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _word_table(name, shared.value)
        model = table.model
        for batch in batches:
            for part in common.slices(batch, "text"):
                split = [t.split() if t else [] for t in common.byte_column(part, "text")]
                at = common.starts(np.fromiter(map(len, split), np.int64, len(split)))
                rows = table.lookup([w for words in split for w in words])
                sums = np.zeros((len(split), len(model.languages) + 1))
                some = np.flatnonzero(np.diff(at))
                if len(some):
                    sums[some] = np.add.reduceat(table.columns[rows], at[some], axis=0)
                found = sums[:, -1] > 0
                scores = _softmax((sums[:, :-1] / np.maximum(sums[:, -1:], 1) + model.bias) / model.temperature)
                best = scores.argmax(axis=1)
                top = np.where(found, np.clip(scores.max(axis=1), 0, 1), 0.0)
                langs = [model.languages[b] if f else "und" for b, f in zip(best.tolist(), found.tolist(), strict=True)]
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(top), pa.array(~found | (top < model.least_score))], names=[*(f.name for f in kept), "lang_pred", "score", "rejected"])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "rejected")
