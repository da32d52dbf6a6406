"""Operators 11 (phrase collocations), 12 (URL filter) and 13 (cross-tokenizer alignment)."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quizmart.llm import collocations, crosstok, urlrules


# ------------------------------------------------------------------ 11
def brute_collocations(rows, least, top=2000):
    counts: dict[str, Counter] = {}
    n = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q[i:j] for q, a in found.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and 100 * a >= 80 * f[q[i:j]]}
        rows_ = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def small_corpus(seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "delta", "ä", "x\u00a0y", "\x1c", "Ünd"]
    rows = [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\r\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(80)]
    return [*rows, *rows[:9], ("en", None), (None, ""), ("en", "hot pair " * 400), ("fr", ".,;:!?\n")]


@pytest.mark.parametrize(("ranges", "shard"), [(1, 1 << 20), (7, 2000), (40, 1)])
def test_collocations_equal_brute_force(spark, ranges, shard, monkeypatch):
    monkeypatch.setattr(collocations, "SAMPLE_CHARS", 64)
    rows = small_corpus()
    docs = spark.createDataFrame([(lang, text, "clash") for lang, text in rows], "lang string, text string, phrase string")
    got = collocations.top_phrases(docs, top=25, min_count=5, ranges=ranges, shard=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 5, 25)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.top_phrases(docs).collect() == []


PHRASES = st.dictionaries(st.lists(st.sampled_from([b"a", b"b", b"ab", b"c"]), min_size=1, max_size=5).map(tuple), st.integers(1, 3), min_size=1)


@settings(max_examples=80, deadline=None)
@given(PHRASES, st.lists(st.lists(st.sampled_from([b"a", b"b", b"ab", b"c", b"d"]), min_size=1, max_size=6).map(tuple)))
def test_transducer_gives_the_counts(counts, asked):
    t = collocations.Transducer(sorted(counts.items()))
    assert list(t.compose(sorted(asked))) == [counts.get(p, 0) for p in sorted(asked)]
    assert len(t.states) == len(set(t.states))  # minimal: no two equal states


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A b c", "b a. c a b", "c\nc c c", "a b a b a", ""]), st.sampled_from([b"x", b"y"])), min_size=1, max_size=6),
       st.sets(st.lists(st.sampled_from([b"a", b"b", b"bb", b"x", b"y"]), min_size=1, max_size=5).map(tuple), max_size=5))
def test_cuts_add_up_to_the_whole(texts, bounds):
    held = collocations.Shard()
    for text, lang in texts:
        held.add(text.encode(), lang)
    whole = held.automaton()
    parts = [collocations.unpack(collocations.pack(p)) for _, p in collocations.cut(whole, sorted(bounds))]
    assert not parts or dict(collocations.union(parts * 2).phrases()) == {p: 2 * n for p, n in whole.phrases()}
    for r, part in collocations.cut(whole, sorted(bounds)):
        low, high = [(), *sorted(bounds)][r], [*sorted(bounds), (b"\xff",)][r]
        assert all(low <= p < high for p, n in part.phrases() if n)


def test_cut_ties_go_to_the_smallest_k():
    counts = {(b"l", b"a"): 10, (b"l", b"b", b"c"): 10, (b"l", b"a", b"b"): 12, (b"l", b"c"): 8}
    assert collocations.best_cut((b"l", b"a", b"b", b"c"), 5, counts) == (500_000, 10, 10)
    big = 10**13  # products beyond 64 bits
    assert collocations.best_cut((b"l", b"a", b"b"), big, {(b"l", b"a"): big, (b"l", b"b"): 2 * big})[0] == 666_666


# ------------------------------------------------------------------ 12
RULES = [urlrules.ListRule(*r) for r in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))]


def test_listed_rules_and_parsing(spark):
    cases = [
        ("http://Www.Example.ORG/es/1?x#y", "www.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
        ("https://badexample.org/en/17", "badexample.org", "/en/17", "org/", "allow"),
        ("https://org", "org", "", None, "allow"),
        ("https://a.com?u=http://b.org/", "a.com", "", None, "allow"),
        ("x://a.com/de/\u00c4", "a.com", "/de/\u00c4", "com/de/", "block"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("http://com/fr/" + "a" * 100_000, "com", "/fr/" + "a" * 100_000, "com/fr/", "allow"),
    ]
    pages = spark.createDataFrame([(i % 3, c[0], "clash", "clash") for i, c in enumerate(cases)], "page_id long, url string, host string, rule string")
    got = urlrules.filter_urls(pages, RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "mined_rule"]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(((i % 3, *c[1:]) for i, c in enumerate(cases)), key=str)
    assert urlrules.filter_urls(pages.limit(0), RULES).collect() == []


def brute_rules(rows, min_support, min_count, min_confidence):
    rows = [(frozenset(t), y) for t, y in rows if y is not None and t]
    both, one = Counter(), Counter()
    for t, y in rows:
        for k in range(1, len(t) + 1):
            for c in combinations(sorted(t), k):
                one[c] += 1
                both[c, y] += 1
    return {(c, y): (n / one[c], n) for (c, y), n in both.items() if n >= min_count and n >= min_support * len(rows) and n / one[c] >= min_confidence}


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        t = [f"s={rng.choice('ab')}", f"t={rng.choice('abc')}", f"u={rng.choice('abcd')}"][: rng.randint(1, 3)]
        rows.append((t, rng.choice(["allow", "block"]) if "t=a" not in t else rng.choice(["block"] * 19 + ["allow"]) if rng.random() < 0.9 else None))
    labelled = spark.createDataFrame(rows, "tokens array<string>, label string")
    mined = urlrules.mine(labelled, 1 / 64, 5, 0.8)
    want = brute_rules(rows, 1 / 64, 5, 0.8)
    assert mined and all(want[r.tokens, r.verdict] == (r.confidence, r.count) for r in mined)
    index = urlrules.RuleIndex(mined)
    for t, _ in rows:  # leaving out needless rules changes no verdict
        fits = [urlrules.MinedRule(c, y, *want[c, y]) for c, y in want if set(c) <= set(t)]
        assert index.best(t) == min(fits, key=urlrules.rank, default=None)
    assert urlrules.mine(labelled.where("label = 'none'")) == []


def test_labels_teach_the_filter(spark):
    urls = [(f"http://www.spam-farm.example.net/en/{i}", "block") for i in range(20)] + [(f"http://good.example.net/en/{i}", "allow") for i in range(20)]
    labels = spark.createDataFrame(urls, "url string, label string")
    pages = spark.createDataFrame([(1, "https://www.spam-farm.example.net/de/5.html"), (2, "http://good.example.net/x/y"), (3, "http://else.where/")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined_rule is not None) for r in urlrules.filter_urls(pages, [], labels).collect()}
    assert got == {1: ("block", True), 2: ("allow", True), 3: ("allow", False)}


# ------------------------------------------------------------------ 13
@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute_alignment(rows, tokenizers):
    a, b = tokenizers
    alphabet = crosstok.byte_alphabet()
    entry = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("\u2581", " ").encode()
    docs, count = [], Counter()
    for doc, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        bx, by = [entry[i] for i in x], [piece(b.id_to_piece(i)) for i in y]
        if not text or not b"".join(bx) == b"".join(by) == (" " + text).encode():
            docs.append((doc, [], [], []))
            continue
        ex, ey = np.cumsum([len(t) for t in bx]).tolist(), np.cumsum([len(t) for t in by]).tolist()
        cuts = sorted(set(ex) & set(ey))
        groups = [([i for i, e in zip(x, ex) if s < e <= c], [i for i, e in zip(y, ey) if s < e <= c]) for s, c in zip([0, *cuts], cuts)]
        count.update((g[-1], h[-1]) for g, h in groups)
        docs.append((doc, x, y, groups))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for doc, x, y, groups in docs:
        links = [(g[-1], h[-1]) for g, h in groups]
        sha = hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if x else ""
        out.append((doc, len(x), len(y), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=str)


ODD = ["Hello world, hello  world", "a", " ", "  two\n\n lines\t\ttabs ", "<|endoftext|> <s> </s> <unk> <0x41>", "\u2581 mark", "x\u00a0y z\u3000w", "\u65e5\u672c\u8a9e \u043f\u0440\u0438\u0432\u0435\u0442 \U0001f600", "don't we'll I'M",
       "caf\u00e9 \u00fcber 12345 67", "\x00\x01 \x85 \x1c x", "e\u0301 \u200b \ufeff", "a" * 5000, "word " * 3000, "\u0378\u1c89 new letters"]


def test_alignment_equals_brute_force(spark, tokenizers):
    rng = random.Random(2)
    alphabet = "ab \n.,'" + "\u00e4\u00df\u0301\u4e2d\u00a0\u2581" + "tTeE09"
    texts = [*ODD, *("".join(rng.choice(alphabet[: rng.choice([7, 12, 99])]) for _ in range(rng.randint(0, 80))) for _ in range(60)), None, "", *ODD[:5] * 3]
    rows = [(i % 70, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_a int").repartition(5)
    for block in (1, 4000, crosstok.BLOCK):
        got = crosstok.link_counts(docs, block=block)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_alignment(rows, tokenizers)
    assert crosstok.link_counts(docs.limit(0)).collect() == []
    arrays = {r.doc_id: r for r in crosstok.alignments(docs.where("text = 'Hello world, hello  world'").limit(1)).collect()}
    (r,) = arrays.values()
    assert r.a_cuts[-1] == len(r.a_ids) and r.b_cuts[-1] == len(r.b_ids) and len(r.a_cuts) == len(r.b_cuts)


def test_both_engines_read_plain_characters_alike(tokenizers):
    enc = crosstok.Encoders(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    for c in range(ord(crosstok.PLAIN) + 1):
        for text in (f" a{chr(c)}b", f" {chr(c)}", f" 1{chr(c)}{chr(c)} {chr(c)}x"):
            assert enc.fast(text) == tokenizers[0].encode(text, add_special_tokens=False).ids, c
    pieces = [enc.b.id_to_piece(i) for i in range(enc.b.get_piece_size())]
    assert not any("\u2581" in p.lstrip("\u2581") for p in pieces) and all(enc.b_text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.data()), min_size=1, max_size=5), st.integers(1, 9))
def test_lockstep_finds_all_common_ends(docs, lane):
    ends_a, ends_b, starts, at = [], [], [0], 0
    for size, data in docs:
        for ends in (ends_a, ends_b):
            ends += [*(at + x for x in sorted(data.draw(st.sets(st.integers(1, size)))) if x < size), at + size]
        at += size
        starts.append(at)
    a, b = crosstok.lockstep(np.array(ends_a), np.array(ends_b), np.array(starts), lane)
    common = sorted(set(ends_a) & set(ends_b))
    assert [ends_a[i] for i in a] == [ends_b[i] for i in b] == common
