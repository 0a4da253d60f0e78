"""SimHash near-duplicates against a brute-force version."""

import re

import numpy as np
import xxhash

from quillgraph.llm import registry, simhash

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    values = np.array(fps, np.uint64)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    fps = [plain_fingerprint(t) for t in docs["text"]]
    ids = docs["doc_id"].tolist()
    expected = {i: (f"{fp:016x}", ids[c]) for i, fp, c in zip(ids, fps, plain_components(fps), strict=True)}
    made = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.op6_simhash(spark, SF).collect()}
    assert made == expected


def test_local_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    for radius in (0, 1, 3, 4, 6):
        base = rng.integers(0, 1 << 63, 12, np.uint64)
        fps = []
        for b in base:
            for _ in range(int(rng.integers(1, 60))):
                flips = rng.integers(0, 64, int(rng.integers(0, 5)))
                fps.append(int(b) ^ int(sum(1 << int(f) for f in set(flips.tolist()))))
        fps = np.unique(np.array(fps, np.uint64))
        rng.shuffle(fps)
        group = np.sort(rng.integers(0, 3, len(fps)))
        a, b = simhash.local_links(group, fps, radius)
        for g in range(3):
            own = fps[group == g].tolist()
            expected = plain_components(own, radius)
            place = {fp: i for i, fp in enumerate(own)}
            label = list(range(len(own)))
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                if x in place and group[fps.tolist().index(x)] == g:
                    label[place[x]] = place[y]
            assert label == expected


def test_hot_bucket_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    rng = np.random.default_rng(9)
    fps = sorted({int(x) for x in rng.integers(0, 1 << 10, 300)} | {int(x) << 50 for x in rng.integers(0, 64, 40)})
    frame = spark.createDataFrame([(fp,) for fp in fps], "fp long")
    labels = {r["node"]: r["label"] for r in simhash.components(simhash.near_links(frame)).collect()}
    expected = plain_components(fps)
    assert [labels.get(fp, fp) for fp in fps] == [fps[c] for c in expected]


def test_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    assert {r["label"] for r in simhash.components(links).collect()} == {0}


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One", "x"), (5, "one", "x"), (5, "one", "x"), (None, "zwei", "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, fp string")
    made = sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    word = f"{xxhash.xxh64_intdigest(b'one', 42):016x}"
    assert made[1:] == [(1, "0" * 16, 1), (2, "0" * 16, 1), (3, "0" * 16, 1), (4, word, 4), (5, word, 4), (5, word, 4)]
    assert made[0][2] is None
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
