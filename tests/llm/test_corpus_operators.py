"""Substring, line and SimHash dedup, decontamination, packing and the pipeline."""
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizmart.llm import common, components, decontaminate, fertility, lines, packing, repeats, simhash

SMALL = "/root/testdata/sf0.001"
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def brute_repeats(docs):
    first = {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        for a in range(len(t) - 49):
            first.setdefault(t[a : a + 50], i)
    out = []
    for i, t in docs:
        mark = bytearray(len(t))
        for a in range(len(t) - 49):
            if first[t[a : a + 50]] < i:
                mark[a : a + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(t, mark, strict=True) if not x)
        out.append((i, len(t), sum(mark), sum(1 for j in range(len(mark)) if mark[j] and (j == 0 or not mark[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 60))) for _ in range(25)]
    docs = []
    for i in range(120):
        text = ""
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))
            text += x[rng.randint(0, 10) : len(x) - rng.randint(0, 10)] if rng.random() < 0.5 else x
        docs.append((i * 3, text))
    docs += [(1000, "a" * 700), (1001, "b" + "a" * 300 + "c" + "a" * 60), (1002, "ab" * 200), (1003, "ab" * 50 + "x" + "ba" * 60), (1004, None), (1005, "")]
    docs += [(7, "a" * 80 + "\0" * 70), (8, "\0" * 120 + "q"), (8, "\0" * 120 + "q"), (8, "z" * 55), (9, "z" * 54 + "\0" * 60)]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, kept string")
    expected = brute_repeats([(i, (t or "").encode()) for i, t in docs])
    for common_from in (512, 1):  # the second sends ambiguous segments window by window
        got = repeats.remove_repeats(df, common_from=common_from).drop("kept").collect()
        assert sorted(map(tuple, got)) == expected
    assert repeats.remove_repeats(df.limit(0)).count() == 0
    null_id = repeats.remove_repeats(spark.createDataFrame([(None, "x" * 60), (1, "x" * 60)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_removed) for r in null_id} == {(None, 60), (1, 0)}


def test_long_document_is_cut_without_effect():
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(repeats.CHUNK + 5000))
    block = repeats.Block([1, 2], [text, text[-3000:]], 4)
    windows = sum((block.last - block.first + 1)[block.doc == 0])
    assert windows == len(text) - 49


def test_repeats_messages_do_not_grow_with_the_buckets():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(200)) for _ in range(600)]
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [i // 2 for i in range(299)] + [(1 << 63) - 1]
    few, many = ([m for _, m in repeats.Block(ids, texts, n).messages()] for n in (8, 512))
    assert len(many) > 500 and sum(map(len, many)) < 1.7 * sum(map(len, few))


def test_repeats_settle_names_the_smallest_document():
    rng = random.Random(6)
    passages = [bytes(rng.choice(b"abcdefgh ") for _ in range(90)) for _ in range(30)]
    ids = [rng.choice([-(1 << 63), -7, 0, 5, 130, 1 << 40, (1 << 63) - 1]) for _ in range(60)]
    texts = [rng.choice(passages) + b"|" + rng.choice(passages) for _ in ids]
    blocks = [repeats.Block(ids[k::3], texts[k::3], 4) for k in range(3)]
    sent = [(b, k, m) for b in blocks for k, m in b.messages()]
    replies = [{} for _ in blocks]
    for bucket in range(4):
        own = [(b, m) for b, k, m in sent if k == bucket]
        for (b, _), x in zip(own, repeats.settle([m for _, m in own]), strict=True):
            replies[blocks.index(b)][bucket] = x
    least = {}
    for b in blocks:
        for r, w in enumerate(b.whole.tolist()):
            least[w] = min(least.get(w, 1 << 63), int(b.ids[b.doc[r]]))
    for b, given_back in zip(blocks, replies, strict=True):
        here = [b.name_of(k) for k in range(len(b.distinct))]
        assert (b.flags(given_back) & 1).tolist() == [int(least[w] < n) for w, n in zip(b.distinct.tolist(), here, strict=True)]


@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1)))
def test_varints(values):
    data, at = repeats.varints(np.array(values, np.int64))
    assert repeats.from_varints(data).astype(np.int64).tolist() == values and at[-1] == len(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\0", max_size=14), min_size=1, max_size=6))
def test_maximal_repeats_equal_brute_force(texts):
    texts = [t.encode() for t in texts]
    least = 8
    text, start, lcp, before = repeats.suffix_array(texts, least)
    got = {(texts[text[a]][start[a] : start[a] + n], tuple(sorted((int(text[k]), int(start[k])) for k in range(a, b)))) for n, a, b in repeats.maximal_repeats(lcp, before, least)}
    places = {}
    for i, t in enumerate(texts):
        for n in range(least, len(t) + 1):
            for a in range(len(t) - n + 1):
                places.setdefault(t[a : a + n], []).append((i, a))
    expected = set()
    for s, at in places.items():
        if len(at) > 1:
            left = {texts[i][a - 1] if a else (i, a) for i, a in at}
            right = {texts[i][a + len(s)] if a + len(s) < len(texts[i]) else (i, a) for i, a in at}
            if len(right) > 1 and (len(left) > 1 or not isinstance(next(iter(left)), int)):
                expected.add((s, tuple(sorted(at))))
    assert got == expected


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edit(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[i] = rng.choice("abé\U0001f600")
        elif kind == 1:
            t.insert(i, rng.choice("abé"))
        elif len(t) > 1:
            del t[i]
    return "".join(t)


def test_banded_distance(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(500):
        a = "".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(1, 14)))
        b = edit(rng, a, rng.randint(0, 4))
        pairs.append((a, b, distance(a, b)))
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    for tau in (1, 2, 3):
        assert df.where(lines.within(F.col("a"), F.col("b"), tau) != (F.col("d") <= tau)).count() == 0


def line_docs():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(10, 30))).strip() for _ in range(30)]
    docs = [(i, "\n".join(edit(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(5))) for i in range(80)]
    return docs + [(200, None), (201, ""), (202, "x\n\ny")] + [(300 + i, f"common start of the lines {i:03d}") for i in range(40)]


def test_line_links_equal_brute_force(spark):
    docs = spark.createDataFrame(line_docs(), "doc_id long, text string")
    found = lines.lines(docs, min_chars=6)
    h = {r.line: r.h for r in found.select("line", "h").distinct().collect()}
    texts = sorted(h)
    expected = {(min(h[a], h[b]), max(h[a], h[b])) for i, a in enumerate(texts) for b in texts[i + 1 :] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    for common in (32, 1):  # the second refines every shared segment
        assert {(r.a, r.b) for r in lines.links(found, 2, common).collect()} == expected


def test_near_copies_do_not_all_meet(spark, monkeypatch):
    rng = random.Random(11)
    base = " ".join("".join(rng.choice("aeobdfgklmnrst") for _ in range(rng.randint(3, 8))) for _ in range(40))
    vowels = [i for i, c in enumerate(base) if c in "aeo" and i > len(base) // 3]
    changed = {frozenset(rng.sample(vowels, 3)) for _ in range(120)}
    changed |= {c | {rng.choice(vowels)} for c in sorted(changed, key=sorted)[:6]}  # one edit more
    texts = {c: "".join("x" if i in c else ch for i, ch in enumerate(base)) for c in changed}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(texts.values()))], "doc_id long, text string")
    found = lines.lines(docs)
    h = {r.line: r.h for r in found.select("line", "h").collect()}
    met, candidates = [], lines.candidates
    monkeypatch.setattr(lines, "candidates", lambda *a, **k: met.append(candidates(*a, **k)) or met[-1])
    got = {(r.a, r.b) for r in lines.links(found).collect()}
    expected = {tuple(sorted((h[texts[a]], h[texts[b]]))) for a in changed for b in changed if a != b and len(a ^ b) <= 2}
    assert got == expected and len(expected) >= 6
    # all lines share a third and differ in the same four letters: about 7,900 pairs, of which most are 6 edits apart
    assert sum(m.count() for m in met) <= 4 * len(changed)


def kept_lines(docs, min_chars=6, tau=2):
    """Brute force of drop_duplicate_lines: lines by document and number."""
    seen, out = [], {}
    for i, text in sorted(((i, t) for i, t in docs if t is not None), key=lambda x: x[0]):
        keep = []
        for line in text.split("\n"):
            s = line.strip(" \t\r\v\f")
            if len(s) >= min_chars:
                gone = any(abs(len(s) - len(x)) <= tau and distance(s, x) <= tau for x in seen)
                seen.append(s)
                if gone:
                    continue
            keep.append(line)
        out[i] = "\n".join(keep)
    return out


def test_drop_duplicate_lines(spark):
    docs = line_docs()[::2]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, line string")
    got = {r.doc_id: r.text for r in lines.drop_duplicate_lines(df, min_chars=6).collect()}
    expected = kept_lines(docs)
    assert {i: t for i, t in got.items() if t is not None} == expected and set(got) == {i for i, _ in docs}
    rows = lines.duplicate_lines(df, min_chars=6).collect()
    assert all((r.class_doc, r.class_line) <= (r.doc_id, r.line) for r in rows)
    assert lines.duplicate_lines(df.limit(0)).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    a, b, c = "first line of the text", "second line of the text, longer", "third one, unlike the others"
    df = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{c}\n{a}"), (2, f"{b}\n{c}"), (None, c)], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in lines.drop_duplicate_lines(df, min_chars=6).collect()}
    # the null id sorts first; both rows with id 2 lose what occurs before
    assert got == {(1, f"{a}\n{b}"), (2, ""), (None, c)}


def test_short_lines(spark):
    texts = ["All rights reserved.", "Share this", "Share thus", "All rights reserved!", "All right reserved!", "}", "}", "Share this", "  All rights reserved.", "x" * 31, "x" * 32, "x" * 33, "x" * 29 + "yzx", "x" * 30 + "yz"]
    df = spark.createDataFrame([(i, f"{t}\n\n") for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lines.duplicate_lines(df).collect()}
    assert len(rows) == len(texts)  # a row for every line, whatever its length
    brute = {i: any(x == t.strip() or distance(x, t.strip()) <= min(2, min(len(x), len(t.strip())) // 16) for x in (y.strip() for y in texts[:i])) for i, t in enumerate(texts)}
    assert {i: r.removed for i, r in rows.items()} == brute
    assert [i for i, gone in brute.items() if gone] == [3, 4, 6, 7, 8, 10, 11, 12, 13]
    kept = {r.doc_id: r.text for r in lines.drop_duplicate_lines(df).collect()}
    assert kept == {i: "\n" if brute[i] else f"{t}\n\n" for i, t in enumerate(texts)}


def test_short_links_equal_brute_force(spark):
    docs = spark.createDataFrame(line_docs(), "doc_id long, text string")
    found = lines.lines(docs)
    h = {r.line: r.h for r in found.select("line", "h").distinct().collect()}
    texts = sorted(h)
    expected = {(min(h[a], h[b]), max(h[a], h[b])) for i, a in enumerate(texts) for b in texts[i + 1 :] if abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, min(len(a), len(b)) // 12)}
    for common in (32, 1):
        assert sorted((r.a, r.b) for r in lines.near_links(found, 2, 24, common).collect()) == sorted(expected)


def brute_fingerprint(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60)
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "One"), (-4, "one TWO"), (-5, "É \x1c b"), (-6, " \n")], "doc_id long, text string")
    both = docs.unionByName(more)
    texts = {r.doc_id: r.text for r in both.collect()}
    for r in simhash.fingerprints(both).collect():
        assert r.fp % (1 << 64) == brute_fingerprint(texts[r.doc_id])
    assert both.where("text = 'one TWO'").select(F.xxhash64(F.lit("one two")).alias("h")).first().h % (1 << 64) == brute_fingerprint("one TWO")


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 63), max_size=3))
def test_masks_cover_every_pair(bits):
    masks = simhash.covering_masks(list(range(64)), 3)
    assert any(all(not m >> b & 1 for b in bits) for m in masks)
    assert max(sum(not m >> b & 1 for b in range(64)) for m in masks) <= 32


def brute_components(fps):
    root = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j in range(i):
                if (a ^ fps[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(8)
    fps = {0, 7}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            fps.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    expected = brute_components(fps)
    groups = {frozenset(signed[i] for i in range(len(fps)) if expected[i] == r) for r in set(expected)}
    for split in (2048, 1):  # the second deals every shared bucket again
        roots = {r.node: r.root for r in components.connected_components(simhash.links(df, 3, split)).collect()}
        found = {}
        for f in signed:
            found.setdefault(roots.get(f, f), set()).add(f)
        assert {frozenset(g) for g in found.values()} == groups


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components.connected_components(df).collect()}
    assert roots == {**{i: 0 for i in range(1, 201)}, 501: 500}
    assert components.connected_components(df.limit(0)).count() == 0


def test_near_duplicates_odd_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(5, text), (3, text.upper()), (9, None), (8, ""), (8, ""), (None, text), (None, "alone in its group"), (4, "other words " * 50)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (3, 3), (9, 8), (8, 8), (None, 3), (None, None), (4, 4)}
    kept = simhash.keep_first(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 3), (False, 4), (False, 8), (True, 0)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def plain_alignment(item, passage):
    best = 0
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            s = 2 if item[i - 1] == passage[j - 1] and item[i - 1] else -1
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=14))
def test_smith_waterman(item, passage):
    score, end, equal = decontaminate.smith_waterman(np.array([item + [0]] * 2), np.array([passage] * 2))
    assert score.tolist() == [plain_alignment(item, passage)] * 2
    assert 0 <= equal[0] <= min(len(item), len(passage)) and end[0] <= len(passage)


def test_decontamination(spark):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 30
    words = items[3].split()
    edited = " ".join("changed" if k % 7 == 3 else w for k, w in enumerate(words))
    reworded = " ".join([w.upper() + "!" for w in words[:10]] + ["inserted", "words"] + words[10:])
    docs = [(1, filler + items[0] + filler), (2, filler + edited + filler), (3, reworded), (4, filler), (5, None), (6, ""), (7, " ".join(words[:4]) + filler), (8, "The " * 5000), (8, "The " * 5000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()}
    assert got == {(1, 0), (2, 3), (3, 3)}
    parts = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench, block_chars=1000).collect()}
    assert parts == got
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8, 8]
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.matches(df.limit(0), bench).count() == 0


def aligned_pairs(docs, items, min_score=0.5):
    """(document, item) pairs whose whole texts align, without seeds."""
    numbers: dict[bytes, int] = {}

    def ids(text):
        return [numbers.setdefault(w, len(numbers) + 1) for w in decontaminate.normal_words(text.encode())]

    out = set()
    for k, item in items.items():
        words = ids(item)
        if len(words) < decontaminate.MIN_WORDS:
            continue
        for d, text in docs.items():
            passage = ids(text or "")
            if len(set(words) & set(passage)) > 2:
                score, _, equal = decontaminate.smith_waterman(np.array([words]), np.array([passage]))
                if score[0] >= min_score * 2 * len(words) and equal[0] >= min(6, len(words)):
                    out.add((d, k))
    return out


def found_pairs(spark, docs, items, **options):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench, **options).collect()}


def test_decontamination_recall_of_edited_copies(spark):
    rng = random.Random(5)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    other = [w for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect() for w in (r.text or "").split()]
    docs = {}
    for how, share in enumerate((0.1, 0.2, 0.25, 0.3, "fourth")):
        for k, text in items.items():
            words = []
            for i, w in enumerate(text.split()):
                if share == "fourth":
                    words.append(rng.choice(other) if i % 4 == 3 else w)
                elif rng.random() >= share:
                    words.append(w)
                else:
                    words += rng.choice(([], [rng.choice(other)], [w, rng.choice(other)], [rng.choice(other)]))
            docs[how * 1000 + k] = " ".join(rng.sample(other, 40) + words + rng.sample(other, 40))
    want = aligned_pairs(docs, items)
    got = found_pairs(spark, docs, items)
    assert got <= want
    for how in range(5):
        due = {p for p in want if p[0] // 1000 == how}
        assert len(due) >= len(items) // 2 and len(due & got) >= 0.9 * len(due), (how, len(due), len(due & got))


def test_decontamination_of_variants_and_blocks(spark):
    words = "which of these seven planets of the outer system turns around its axis in the shortest time of all".split()
    items = {k: " ".join(words[: 3 * k] + [f"variant{k}"] + words[3 * k + 1 :]) for k in range(6)}
    items |= {100 + k: f"question {k} of these planets which of these is not listed in book{k}" for k in range(20)}
    docs = {k: "Before it. " + t.replace(f"variant{k}", "another") + " After it." for k, t in items.items() if k < 6}
    got = found_pairs(spark, docs, items)
    assert {(d, k) for d in docs for k in range(6)} <= got
    assert found_pairs(spark, docs, items, block_chars=1) == found_pairs(spark, docs, items, block_chars=300) == got


def test_decontamination_of_unspaced_and_short_items(spark):
    items = {1: "世界上最長的河流是哪一條河流？請寫出答案。", 2: "What is DNA?", 3: "Yes.", 4: "人工智能", 5: "", 6: None, 7: "What is DNA?", 8: "la " * 400}
    docs = {1: "我們問：世界上最长的河流是哪一條河流？請寫出答案。謝謝", 2: "Q: what is DNA?\nA: a molecule", 3: "Tell me what is DNA made of. Yes. Yes.", 4: "他研究人工智能很多年了", 5: "x\n人工智能\ny", 6: "la " * 9000, 7: None, 8: ""}
    assert found_pairs(spark, docs, items) == {(1, 1), (2, 2), (2, 7), (5, 4), (6, 8)}


def test_token_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(1)
    signs = " \n\t\v\x1c\x85  aAbB'sS'tT'll're<|endoftext|>.,!?#$%0123éÉßİΣσς日\U0001f600́ﬁ\0﻿​"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|>a <|startoftext|>", "don't DON'T we'll", "", "A B"]
    ids, at = packing.token_ids([x.encode() for x in texts] + [None], TOKENIZER)
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1]
    assert ids[at[-2] :].tolist() == [1]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_places_every_piece_once(histogram):
    used = {}
    count = dict.fromkeys(histogram, 0)
    for length, rank, n, first, offset in packing.plan(histogram, 40):
        assert rank == count[length]
        count[length] += n
        for s in range(first, first + n):
            used.setdefault(s, []).append((offset, length))
    assert count == histogram
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    total = sum(k * v for k, v in histogram.items())
    assert len(used) <= max(1, 2 * total // 40 + 1)


def test_packing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "word " * 9000), (10_003, "same"), (10_003, "same"), (None, "null id")], "doc_id long, text string")
    both = docs.unionByName(more).withColumn("offset", F.lit("clash"))
    out = [r.asDict() for r in packing.pack(both).collect()]
    pieces = {}
    for r in out:
        pieces.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in pieces.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in out)
    assert len(pieces) <= 1.05 * total / 4096 + 1
    texts = {r.doc_id: r.text for r in both.collect()}
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(TOKENIZER)
    for r in out:
        if r["doc_id"] in (10_000, 10_002) or (r["doc_id"] or 10**9) < 40:
            ids = [*t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and len(piece) == r["length"]
            assert r["start"] == 4096 * r["piece"]
    assert sum(r["doc_id"] == 10_003 for r in out) == 2 and sum(r["doc_id"] is None for r in out) == 1
    assert packing.pack(both.limit(0)).count() == 0


def test_pipeline_stages_send_texts_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat("id", F.lit(" words ")), 1000).alias("text"), F.lit("en").alias("lang"))
    benchmark = spark.createDataFrame([(1, "six words of a benchmark item here")], "item_id long, text string")
    stages = {
        "quality_rules": lambda: fertility.keep_good(docs.limit(40)),
        "simhash_near_dedup": lambda: simhash.fingerprints(docs),
        "benchmark_decontamination": lambda: decontaminate.keep_clean(docs, benchmark),
        "best_fit_packing": lambda: packing.pieces(docs),
    }

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "n"])

    for name, stage in stages.items():
        spark.conf.unset(key)
        stage()
        got = docs.select("text").mapInArrow(sizes, "bytes long, n long").collect()
        assert sum(r["n"] for r in got) == 1500, name
        assert max(r["bytes"] for r in got) <= common.BATCH_BYTES + (64 << 10), name
    spark.conf.set(key, str(1 << 20))
    common.small_batches(spark)
    assert spark.conf.get(key).rstrip("b") == str(1 << 20)  # a smaller setting stays
    spark.conf.unset(key)


def test_fertility_memo_is_bounded_and_forgets_without_changing_measures():
    table = fertility._build(common.TOKENIZER_DIR)
    assert table.limit <= 300_000
    texts = [" ".join(f"w{i * k}" for i in range(60)).encode() for k in range(1, 30)]

    def described():
        rows = [(table.lookup(t.split()), table.columns) for t in texts]
        return [columns[at].tolist() for at, columns in rows]

    whole = described()
    table.limit = 50
    table._clear()
    assert described() == whole
    assert table.size < 50 + 2 * 60
