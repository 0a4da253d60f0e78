"""Language-model scores against a plain version."""

import math
import re
from collections import Counter

import pytest

from quillgraph.llm import registry, stupid_backoff

SF = "/root/testdata/sf0.001"


def plain(texts):
    lower = [re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    marked = [[0, *w, 1] if w else [] for w in lower]
    ones = Counter(w for m in marked for w in m)
    twos = Counter(p for m in marked for p in zip(m, m[1:]))
    total = sum(ones.values())
    return [
        sum(
            math.log(twos[p] / ones[p[0]]) if twos[p] >= 2 else math.log(0.4 * ones[p[1]] / total)
            for p in zip(m, m[1:])
        )
        for m in marked
    ]


@pytest.mark.parametrize("entries, share, rows", [(1 << 19, 1 / 1000, 4096), (2000, 1 / 30, 7), (500, 2.0, 64)])
def test_scores_equal_plain_version(spark, monkeypatch, entries, share, rows):
    monkeypatch.setattr(stupid_backoff, "BUCKET_ENTRIES", entries)
    monkeypatch.setattr(stupid_backoff, "HOT_SHARE", share)
    monkeypatch.setattr(stupid_backoff, "SLICE_DOCS", rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    expected = dict(zip(docs["doc_id"], plain(docs["text"]), strict=True))
    made = stupid_backoff.score_documents(spark.read.parquet(f"{SF}/documents.parquet").repartition(3)).collect()
    assert len(made) == len(docs)
    for r in made:
        assert r["log_score"] == pytest.approx(expected[r["doc_id"]], rel=1e-12)


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "a b a b"), (4, "a b a b"), (None, "A c"), (5, "z")]
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in texts], "doc_id int, text string, n_words double")
    made = stupid_backoff.score_documents(docs).collect()
    expected = sorted((k or 0, round(s, 9)) for (k, _), s in zip(texts, plain([t for _, t in texts]), strict=True))
    assert sorted((r["doc_id"] or 0, round(r["log_score"], 9)) for r in made) == expected
    assert {r["doc_id"]: r["mean_log_score"] for r in made if r["doc_id"] in (1, 2, 3)} == {1: None, 2: None, 3: None}
    assert stupid_backoff.score_documents(docs.limit(0)).count() == 0


def test_query_has_every_document(spark):
    assert registry.op9_stupid_backoff(spark, SF).count() == 200
