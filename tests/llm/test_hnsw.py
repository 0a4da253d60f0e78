"""Graph search against brute force."""

import numpy as np
import pytest

from quillgraph.llm import hnsw, registry

SF = "/root/testdata/sf0.1"


def brute(ids, vectors, query_ids, k):
    expected = {}
    for q in query_ids:
        scores = vectors @ vectors[ids.index(q)]
        expected[q] = [ids[i] for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
    return expected


def test_query_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, vectors = rows["vec_id"].tolist(), np.stack(rows["embedding"]).astype(float)
    expected = brute(ids, vectors, [i for i in ids if i % 20 == 0], 20)
    made = registry.op3_hnsw(spark, SF).toPandas()
    assert len(made) == 20 * len(expected)
    hits = 0
    for q, group in made.groupby("query_id"):
        group = group.sort_values("rank")
        assert group["rank"].tolist() == list(range(1, 21))
        assert q not in group["vec_id"].tolist()
        scores = [float(vectors[ids.index(q)] @ vectors[ids.index(v)]) for v in group["vec_id"]]
        assert np.allclose(scores, group["score"], rtol=0, atol=1e-12)
        assert sorted(zip(-group["score"], group["vec_id"], strict=True)) == list(zip(-group["score"], group["vec_id"], strict=True))
        hits += len(set(expected[q]) & set(group["vec_id"]))
    assert hits / (20 * len(expected)) >= 0.95


def test_many_shards_and_lengths(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 16)) * rng.uniform(0.2, 3, (3000, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    made = hnsw.search_index(hnsw.build_index(frame, shard_rows=400), frame.filter("vec_id % 50 = 0"), 10, query_block=16)
    expected = brute(list(range(3000)), vectors, range(0, 3000, 50), 10)
    found = made.toPandas().groupby("query_id")["vec_id"].apply(set)
    assert sum(len(found[q] & set(v)) for q, v in expected.items()) / 600 >= 0.9


def unit_vectors():
    vectors = np.random.default_rng(9).normal(size=(3000, 16))
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@pytest.mark.parametrize(
    ("place", "factor"), [(17, 1e4), (17, 1e3), (slice(None), 1e-25), (slice(None), 1e25), (slice(0, 1500), 1e-200), (slice(None), 1e150)]
)
def test_recall_holds_at_any_length(spark, place, factor):
    """One long vector, tiny and huge ones, two scales: lengths are no reason to miss a neighbour."""
    vectors = unit_vectors()
    vectors[place] *= factor
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    made = hnsw.search_index(hnsw.build_index(frame, shard_rows=1000), frame.filter("vec_id % 20 = 0"), 20)
    found = made.toPandas().groupby("query_id")["vec_id"].apply(set)
    expected = brute(list(range(3000)), vectors, range(0, 3000, 20), 20)
    assert sum(len(found[q] & set(v)) for q, v in expected.items()) / (20 * len(expected)) >= 0.95


def test_rows_equal_in_id_and_vector_are_spread(spark):
    frame = spark.createDataFrame([(7, [1.0, 2.0])] * 900 + [(i, [i / 9, 1.0]) for i in range(8, 40)], "vec_id long, embedding array<double>")
    index = hnsw.build_index(frame.repartition(4), shard_rows=200)
    held = [len(np.frombuffer(r["ids"], np.int64)) for r in index.collect()]
    assert sum(held) == 932 and max(held) < 400


@pytest.mark.parametrize("copies", [3, 700])
def test_copies_and_ties(spark, copies):
    rng = np.random.default_rng(copies)
    base = rng.normal(size=(60, 8))
    vectors = np.concatenate([base, np.repeat(base[:1], copies, 0)])
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    made = hnsw.nearest(frame, frame.filter("vec_id = 0"), 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in made] == brute(list(range(len(vectors))), vectors, [0], 5)[0]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, None), (6, [None, 1.0]), (7, [inf, 1.0]),
        (8, []), (9, [1.0]), (None, [1.0, 1.0]), (10, [-1.0, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = hnsw.nearest(frame, frame, 20).collect()
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in made}
    assert found == {
        (1, 1): (2, 0.5), (1, 2): (10, -1.0), (2, 1): (1, 0.5), (2, 2): (10, -0.5), (10, 1): (2, -0.5), (10, 2): (1, -1.0),
    }
    assert hnsw.nearest(frame.limit(0), frame, 3).count() == 0
    assert hnsw.nearest(frame, frame.limit(0), 3).count() == 0


def test_repeated_query_rows(spark):
    """Every row of a repeated query id gets its own whole answer, over all shards."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(300, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    one, two = frame.filter("vec_id = 7"), frame.filter("vec_id = 9")
    asked = one.union(one).union(one).union(two)
    made = hnsw.search_index(hnsw.build_index(frame, shard_rows=80), asked, 20, query_block=2).collect()
    for q, times in ((7, 3), (9, 1)):
        own = sorted((r["rank"], r["vec_id"]) for r in made if r["query_id"] == q)
        expected = brute(list(range(300)), vectors, [q], 20)[q]
        assert own == [(rank, v) for rank, v in enumerate(expected, 1) for _ in range(times)]
