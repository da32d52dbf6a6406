"""The registered training-data queries at sf0.001 and the pipeline against its steps."""
import inspect

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quizmart.llm import fertility, simhash
from quizmart.llm.queries import ORACLE, QUERIES
from quizmart.plans.verify import compare_one, duck

from .test_corpus_operators import aligned_pairs, brute_components, distance

SMALL = "/root/testdata/sf0.001"


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    r = compare_one(spark, duck(SMALL), name, entry.queries()[name], ORACLE[name], SMALL)
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    table = {"op6_html_extraction": "pages"}.get(name, "documents")
    n = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    got = entry.queries()[name](spark, SMALL).count()
    assert got == n or name in ("op3_line_dedup", "op4_benchmark_decontamination", "op9_best_fit_packing")


def test_pipeline_equals_its_steps(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    docs = sorted((d for d, k in zip(docs, brute_verdicts(docs), strict=True) if k), key=lambda d: d["doc_id"])
    seen: dict[int, set[str]] = {}
    for d in docs:
        keep = []
        for line in d["text"].split("\n"):
            s = line.strip(" \t\r\v\f")
            if s:
                near = [x for n in range(len(s) - 2, len(s) + 3) for x in seen.get(n, ())]
                gone = s in seen.get(len(s), ()) or any(within(s, x, min(2, len(s) // 16, len(x) // 16)) for x in near)
                seen.setdefault(len(s), set()).add(s)
                if gone:
                    continue
            keep.append(line)
        d["text"] = "\n".join(keep)
    fps = [simhash.fingerprint(d["text"].encode()) for d in docs]
    docs = [d for i, (d, r) in enumerate(zip(docs, brute_components(fps), strict=True)) if i == r]
    leaks = aligned_pairs({d["doc_id"]: d["text"] for d in docs}, {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()})
    docs = [d for d in docs if d["doc_id"] not in {d for d, _ in leaks}]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == {d["doc_id"] for d in docs}
    assert len(corpus_pipeline.STAGES) == 5 and all(len(inspect.signature(f).parameters) == 3 for _, f in corpus_pipeline.STAGES)


def within(a, b, edits):
    if not edits or abs(len(a) - len(b)) > edits:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    return len(a) <= 60 and len(b) <= 60 and distance(a, b) <= edits


def brute_verdicts(docs):
    """The quality verdicts with bands learned here: of every language with 30 texts of 100 tokens, the
    lower quartile less 1.5 interquartile ranges, at least 5 % below the median."""
    found = fertility.measure([d["text"].encode() for d in docs], [d["lang"] for d in docs], fertility.common.TOKENIZER_DIR, fertility.BANDS)
    rows = [dict(zip(found, r, strict=True)) | {"key": d["lang"] or b} for d, b, r in zip(docs, found["bands"], zip(*found.values(), strict=True), strict=True)]
    learned = {}
    for key in {r["key"] for r in rows}:
        fit = [r for r in rows if r["key"] == key and not r["base_failed"] and r["word_chars"] >= 100 * max(r["chars_per_token"], r["chars_per_piece"])]
        if len(fit) >= 30:
            quarters = [np.percentile([round(r[c], 3) for r in fit], [25, 50, 75]) for c in ("chars_per_token", "chars_per_piece")]
            learned[key] = [(min(a - 1.5 * (c - a), 0.95 * b), b) for a, b, c in quarters]
    out = []
    for r in rows:
        below = []
        for (fence, median), per in zip(learned.get(r["key"], ()), (r["chars_per_token"], r["chars_per_piece"])):
            below.append((fence - per) / median * (r["word_chars"] / per) ** 0.5 if per else 0.0)
        out.append(r["kept"] and not (below and (max(below) > 4.5 or min(below) > 1.5)))
    return out
