"""Exact duplicates against a plain grouping."""

import hashlib
import re

import pytest

from quillgraph.llm import refined_dedup
from quillgraph.llm.refined_dedup import exact_groups

SCHEMA = "doc_id long, text string, row long, keep_id string, length int, n int"


def plain(rows):
    """``doc_id, keep_id, group_size, kept, sha`` of each (doc_id, text), sorted."""
    groups = {}
    for at, (doc_id, text) in enumerate(rows):
        bare = re.sub(r"[\x20\x09-\x0d]", "", text or "")
        groups.setdefault(bare, []).append((-len(text or ""), doc_id is None, doc_id or 0, at))
    out = []
    for bare, members in groups.items():
        members.sort()
        first = None if members[0][1] else members[0][2]
        for place, (_, unnamed, doc_id, _) in enumerate(members):
            out.append((None if unnamed else doc_id, first, len(members), place == 0, hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, partitions=3):
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], SCHEMA).repartition(partitions)
    made = exact_groups(docs, digest=True)
    assert made.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in made.collect()), key=str)


def test_blanks_ties_nulls_and_repeats(spark):
    rows = [(3, "a b"), (2, "ab"), (1, "a\tb"), (9, " a  b "), (4, None), (5, ""), (6, "\n\x0b"), (7, "ab\x1c"), (8, "x y"), (10, "x y"), (11, "xy")]
    rows += [(20, "same"), (20, "same"), (None, "same"), (None, "alone"), (None, "twice"), (None, "twice")]
    assert found(spark, rows) == plain(rows)


def test_same_length_and_prefix_are_told_apart(spark):
    head = "é" * 100
    rows = [(i, head + t) for i, t in enumerate(["a", "b", "a ", "c", "dd", "d d", "x" * 3])]
    assert found(spark, rows) == plain(rows)


def test_long_texts_and_a_hot_group(spark):
    big = "lorem ipsum " * 400_000
    rows = [(0, big), (1, big + "."), (2, big.replace(" ", "\n")), *((100 + i, "hot one") for i in range(300)), *((1000 + i, f"t {i % 150}") for i in range(300))]
    assert found(spark, rows, 7) == plain(rows)


def test_a_full_bit_field_costs_work_only(spark, monkeypatch):
    monkeypatch.setattr(refined_dedup, "shared_prefixes", lambda texts: refined_dedup.np.full(refined_dedup.FIELD_BITS // 32, 0xFFFFFFFF, "u4"))
    rows = [(i, f"text {i % 7}") for i in range(20)] + [(50, "other")]
    assert found(spark, rows) == plain(rows)


def test_unshared_texts_are_not_hashed(spark, monkeypatch):
    """Lengths alone, then prefixes alone, leave nothing for the full hash."""
    docs = spark.createDataFrame([("a" * n,) for n in range(1, 40)] + [(f"{n:02d}",) for n in range(60, 90)], "text string")
    field = refined_dedup.shared_prefixes(docs.selectExpr("cast(text as binary) as text"))
    assert not field.any()


@pytest.mark.parametrize("text", ["int", "string"])
def test_empty_table_and_other_types(spark, text):
    empty = spark.createDataFrame([], f"doc_id string, text {text}")
    assert exact_groups(empty).count() == 0
    some = spark.createDataFrame([("b", 1), ("a", 1)], "doc_id string, text int")
    assert sorted(map(tuple, exact_groups(some).collect())) == [("a", "a", 2, True), ("b", "a", 2, False)]
