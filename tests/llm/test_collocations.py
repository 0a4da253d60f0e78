"""Collocations against plain counting, and the guarantee of the summaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import collocations as co

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    pieces = re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in pieces]


def plain_collocations(rows, threshold, top, longest=5):
    counts, totals = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for words in plain_words(text):
            totals[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        candidates = {p: c for p, c in own.items() if len(p) > 1 and c >= threshold}
        gone = {p[i : i + m] for p, c in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if c >= own[p[i : i + m]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed, docs=150):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Über", "naïve", "日本", "x_y"]
    rows = []
    for _ in range(docs):
        words = []
        for _ in range(pick.randrange(60)):
            words += pick.choice([["new", "york", "city", "hall", "steps"], ["New", "York"], [pick.choice(vocabulary)], ["as", "well", "as"]])
            words[-1] += pick.choice(["", "", "", ".", ",", "\r", "?!"])
        rows.append((pick.choice(["en", "de", None]), pick.choice([" ", "  ", "\t"]).join(words)))
    return rows


def found(spark, rows, **options):
    docs = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, n long, phrase string").repartition(3)
    return sorted(map(tuple, co.collocations(docs, **options).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counting(spark, seed):
    rows = corpus(seed) + [("en", None), ("en", ""), ("fr", "..."), (None, "a a a a a a a a a a a a a")]
    assert found(spark, rows, threshold=8, top=40) == plain_collocations(rows, 8, 40)


def test_small_summaries_and_blocks(spark, monkeypatch):
    """Texts cut into many blocks, counts sent in many parts, summaries that must cut."""
    monkeypatch.setattr(co, "BLOCK", 200)
    monkeypatch.setattr(co, "GATHERED", 300)
    monkeypatch.setattr(co, "PHRASES", 20)
    rows = corpus(3, 60) + [("en", " ".join(t for _, t in corpus(4, 60)))]
    assert found(spark, rows, threshold=6, top=30, capacity=64) == plain_collocations(rows, 6, 30)


def test_full_bit_fields_cost_work_only(spark, monkeypatch):
    monkeypatch.setattr(co, "bit_field", lambda keys, place: np.full(co.FIELD_BITS // 32, 0xFFFFFFFF, "u4"))
    monkeypatch.setattr(co, "COUNTED", 1 << 30)
    rows = corpus(5, 60)
    assert found(spark, rows, threshold=6, top=30) == plain_collocations(rows, 6, 30)


def test_repeated_rows_and_empty_table(spark):
    rows = [("en", "deep learning rocks")] * 12 + [("en", "deep sea")] * 3
    assert found(spark, rows, threshold=12, top=5) == plain_collocations(rows, 12, 5)
    assert found(spark, [], threshold=2) == []


def test_megabyte_text_and_giant_word():
    text = ("alpha beta gamma. " * 70_000 + "q" * 2_500_000 + " alpha beta " + "z" * 1_200_000 + " omega").encode()
    counts = Counter()
    total = 0
    for block, old in co.blocks(iter([text])):
        words = co.Words(block, 5)
        total += len(words) - old
        for n, key, whole in co.keys_of(words, 3, old):
            counts.update((n, words.text(i, i + n - 1)) for i in np.flatnonzero(whole).tolist() if n > 1)
    assert total == 210_000 + 5
    assert counts[2, b"alpha beta"] == 70_001 and counts[3, b"alpha beta gamma"] == 70_000 and counts[2, b"gamma alpha"] == 0
    assert counts[2, b"beta " + b"z" * 1_200_000] == 1 and counts[3, b"beta " + b"z" * 1_200_000 + b" omega"] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB .,\n\tzé", max_size=40), max_size=8), st.integers(5, 60))
def test_blocks_hold_every_ngram_once(texts, size):
    expected = Counter()
    for text in texts:
        for words in plain_words(text):
            for n in range(1, 6):
                expected.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    found_here, before = Counter(), co.BLOCK
    co.BLOCK = size
    try:
        for block, old in co.blocks(iter([t.encode() for t in texts])):
            words = co.Words(block, 1)
            for n, key, whole in co.keys_of(words, 5, old):
                found_here.update(words.text(i, i + n - 1).decode() for i in np.flatnonzero(whole).tolist())
    finally:
        co.BLOCK = before
    assert found_here == expected


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(2, 30))
def test_no_frequent_key_is_lost(seed, capacity, threshold):
    pick = np.random.default_rng(seed)
    summary, truth = co.Summary(threshold, capacity), Counter()
    for _ in range(12):
        keys = np.unique((pick.pareto(0.6, 60) * 3).clip(0, 500).astype(np.uint64))
        counts = pick.integers(1, threshold + 3, len(keys))
        truth.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        summary.add(keys, counts)
    assert {k for k, c in truth.items() if c >= threshold} <= set(summary.survivors().tolist())
    assert summary.taken < threshold
    if summary.capacity == capacity:
        assert len(summary.keys) <= capacity


def test_capacity_over_mass_by_threshold_needs_no_more():
    """Capacity above mass / threshold never has to grow."""
    pick = np.random.default_rng(3)
    keys = pick.integers(0, 5000, 200_000).astype(np.uint64)
    threshold = 100
    summary = co.Summary(threshold, len(keys) // threshold + 1)
    for part in np.array_split(keys, 50):
        own, counts = np.unique(part, return_counts=True)
        summary.add(own, counts)
    summary.survivors()
    assert summary.capacity == len(keys) // threshold + 1 and summary.taken < threshold
