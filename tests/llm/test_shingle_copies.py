"""Near copies of the pipeline's stage against all pairs of shingle sets."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from quillgraph.llm import shingle_copies


def plain_groups(texts):
    """Smallest place that links of Jaccard >= 0.8 reach, over all pairs."""
    sets = []
    for text in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode("utf-8", "replace").split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            low, high = sorted((len(a), len(sets[j])))
            if 5 * low >= 4 * high and 5 * (n := len(a & sets[j])) >= 4 * (low + high - n):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def words(*numbers):
    return " ".join(f"w{n}" for n in numbers)


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(3), "").collect())


def test_threshold_is_exact(spark):
    base = list(range(94))  # 90 shingles; one changed at the end leaves 89 of 91, ten leave 80 of 100
    at, below = [*base[:-10], *range(500, 510)], [*base[:-11], *range(600, 611)]
    assert kept(spark, [(1, words(*base)), (2, words(*at))]) == [1]
    assert kept(spark, [(1, words(*base)), (2, words(*below))]) == [1, 2]


def test_fingerprints_propose(spark, monkeypatch):
    """Without bands, SimHash still finds copies within its radius, and verifies them."""
    monkeypatch.setattr(shingle_copies, "bands", lambda hashes: np.zeros(0, np.int64))
    rows = [(i, words(*range(1000 * (i // 3), 1000 * (i // 3) + 600 + i % 3))) for i in range(12)] + [(90, None), (91, "alone")]
    assert kept(spark, rows) == [0, 3, 6, 9, 90, 91]
    # one fingerprint, but no similar sets
    monkeypatch.setattr(shingle_copies, "majority", lambda hashes: 7)
    assert kept(spark, [(i, words(*range(50 * i, 50 * i + 30))) for i in range(5)]) == [0, 1, 2, 3, 4]


def test_texts_are_not_sent_to_be_parted(spark):
    """Python is handed one number per row, whatever the rows hold; both sides together are all rows."""
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "row long, text string")
    some, rest = shingle_copies.parted(rows, rows.filter("row % 7 = 0").select("row"), "row")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "found(pmod(" in plan
    made, others = some.collect(), rest.collect()
    assert {r["row"] for r in made} >= set(range(0, 50, 7)) and made[0].asDict() in [r.asDict() for r in rows.collect()]
    assert sorted(r["row"] for r in made + others) == list(range(50))


def test_chain_is_one_group(spark):
    rows = [(i, words(*range(3 * i, 3 * i + 100))) for i in range(60)]
    assert kept(spark, rows) == [0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_equals_all_pairs(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    expected = {rows[g][0] for g in plain_groups([t for _, t in rows])}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == expected


@pytest.mark.parametrize("part", [(1 << 20, 4096), (200, 4096), (1 << 20, 5)])
def test_open_bands_meet_every_pair(spark, monkeypatch, part):
    """All texts share each band, so that only the parts of the band tell who is near whom."""
    monkeypatch.setattr(shingle_copies, "bands", lambda hashes: shingle_copies.np.zeros(min(1, len(hashes)), "int64"))
    monkeypatch.setattr(shingle_copies, "PART_HASHES", part[0])
    monkeypatch.setattr(shingle_copies, "PART_ROWS", part[1])
    monkeypatch.setattr(shingle_copies, "CENTRE_ROWS", 4)
    texts = [words(*range(1000 * (i % 7), 1000 * (i % 7) + 60), *range(i // 7, i // 7 + 2)) for i in range(28)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    made = {r["row"]: r["group"] for r in shingle_copies.copy_groups(rows).collect()}
    assert [made.get(i, i) for i in range(28)] == plain_groups(texts) == [i % 7 for i in range(28)]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 30), st.booleans())
def test_forest_joins_what_similar_sets_join(seed, count, across):
    pick = np.random.default_rng(seed)
    base = [np.unique(pick.integers(0, 60, pick.integers(1, 25))) for _ in range(4)]
    sets = []
    for _ in range(count):
        own = base[pick.integers(4)]
        sets.append(np.unique(np.concatenate([own[pick.random(len(own)) < 0.93], pick.integers(100, 140, pick.integers(0, 3))])).astype(np.uint64))
    sides = pick.integers(0, 2, count) if across else np.zeros(count, int)
    labels = pick.integers(0, count, count) * 10

    def reach(pairs):
        label = {v: v for v in labels.tolist()}
        for a, b in pairs:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
        return label

    both = across and len(set(sides.tolist())) > 1
    near = [
        (int(labels[i]), int(labels[j]))
        for i in range(count) for j in range(i + 1, count)
        if len(sets[i]) and len(sets[j]) and shingle_copies.similar(sets[i], sets[j]) and (not both or sides[i] != sides[j])
    ]
    made = shingle_copies.forest(labels, sides, sets)
    assert reach(made) == reach(near) and len(made) < max(1, len(set(labels.tolist())))


def test_large_groups_make_few_rows(spark, monkeypatch):
    """300 texts share a passage and bands without being near: pairs are not made, whatever their number."""
    keys = shingle_copies.bands
    monkeypatch.setattr(shingle_copies, "bands", lambda hashes: np.append(keys(hashes), 7) if len(hashes) else keys(hashes))
    texts = [words(*range(60), *range(1000 * i, 1000 * i + 30)) for i in range(1, 301)] + [words(*range(60), *range(1000, 1030), 5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    counted = []
    cut = shingle_copies.cut_lineage
    monkeypatch.setattr(shingle_copies, "cut_lineage", lambda df: (made := cut(df), counted.append(made.count()))[0])
    assert sorted(map(tuple, shingle_copies.copy_groups(rows).collect())) == [(0, 0), (300, 0)]
    assert max(counted) <= 21 * 301
