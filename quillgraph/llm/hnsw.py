"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Rows are dealt to shards of bounded size.  A shard's graph has levels; each
node keeps, on every level it reaches, links to near nodes chosen so that they
lead in different directions.  A graph is stored as flat arrays: per level the
nodes, the offsets and the neighbours.  A search goes down the levels greedily
and widens on the lowest; the shards' results are merged.

Largest inner product is searched as smallest distance: a further coordinate
gives all vectors of a shard the same length.  So that this coordinate does not
drown the others, a shard holds vectors of one band of lengths, a factor of two
wide, and is scaled by its own power of two; queries have length one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import bound, cut_lineage

SHARD_ROWS = 12_000
LINKS = 16
CANDIDATES = 96
BREADTH = 128
EXPANDED = 4
#: Bytes of query vectors that meet a shard at once; a shard is copied once per so many.
QUERY_BLOCK_BYTES = 64 << 20
SEED = 11
STEP = 512

GRAPH_SCHEMA = (
    "shard int, dim int, ids binary, member_offsets binary, vectors binary, nodes binary, offsets binary, neighbours binary, levels binary"
)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, dim, v`` of the vectors that can take part: no null, no zero vector, finite components only."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return rows.filter(~bad).filter(F.exists("v", lambda x: x != 0)).select("vec_id", F.size("v").alias("dim"), "v")


def length_band(v: Column) -> Column:
    """The nearest power of two of a vector's length, as an exponent; no square leaves the range of a double."""

    def of(largest: Column) -> Column:
        squares = F.aggregate(v, F.lit(0.0), lambda total, x: total + (x / largest) * (x / largest))
        return F.floor(F.log2(largest) + F.log2(squares) / 2 + 0.5).cast("int")

    return bound(F.greatest(F.array_max(v), -F.array_min(v)), of)


def scaled_points(vectors: np.ndarray) -> np.ndarray:
    """The vectors as single-precision points of equal length: scaled by a power of two, with one coordinate more."""
    exponent = int(np.frexp(np.abs(vectors).max())[1])
    near_one = np.ldexp(vectors, -exponent)
    length = np.einsum("ij,ij->i", near_one, near_one)
    return np.concatenate([near_one, np.sqrt(np.maximum(length.max() - length, 0))[:, None]], 1).astype(np.float32)


def unit_length(vectors: np.ndarray) -> np.ndarray:
    """Each vector divided by its length, whatever its magnitude."""
    near_one = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])
    return near_one / np.sqrt(np.einsum("ij,ij->i", near_one, near_one))[:, None]


def _nearest(points: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other points of each point, nearest first, by blocked matrix products."""
    n = len(points)
    k = min(k, n - 1)
    half = 0.5 * np.einsum("ij,ij->i", points, points)
    found = np.empty((n, k), np.int32)
    for at in range(0, n, STEP):
        closeness = points[at : at + STEP] @ points.T - half
        rows = np.arange(len(closeness))
        closeness[rows, at + rows] = -np.inf
        best = np.argpartition(-closeness, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-closeness, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(closeness, best, 1), axis=1, kind="stable")
        found[at : at + STEP] = np.take_along_axis(best, order, 1)
    return found


def _diverse(points: np.ndarray, near: np.ndarray, links: int) -> list[np.ndarray]:
    """Of each point's near ones, nearest first, those no kept one is closer to; filled up with the nearest left out."""
    chosen = []
    for at in range(0, len(points), STEP):
        own = near[at : at + STEP]
        group = points[own]
        gaps = np.einsum("nkd,nkd->nk", group, group)
        between = gaps[:, :, None] + gaps[:, None, :] - 2 * np.matmul(group, group.transpose(0, 2, 1))
        centre = points[at : at + STEP, None, :] - group
        distance = np.einsum("nkd,nkd->nk", centre, centre)
        kept = np.zeros(own.shape, bool)
        count = np.zeros(len(own), int)
        for k in range(own.shape[1]):
            nearer = (between[:, :, k] < distance[:, k, None]) & kept
            take = ~nearer.any(1) & (count < links)
            kept[:, k] = take
            count += take
        spare = np.where(kept, 0, 1) * (own.shape[1] + 1) + np.arange(own.shape[1])
        order = np.argsort(spare, axis=1)[:, :links]
        chosen.extend(np.take_along_axis(own, order, 1))
    return chosen


def _connected(count: int, links: list[set[int]], points: np.ndarray) -> None:
    """Tie what cannot be reached from node 0 to its nearest reached node, both ways."""
    reached = np.zeros(count, bool)
    stack = [0]
    reached[0] = True
    while True:
        while stack:
            for other in links[stack.pop()]:
                if not reached[other]:
                    reached[other] = True
                    stack.append(other)
        rest = np.flatnonzero(~reached)
        if not len(rest):
            return
        inside = np.flatnonzero(reached)
        gap = ((points[inside] - points[rest[0]]) ** 2).sum(1)
        near = int(inside[gap.argmin()])
        links[near].add(int(rest[0]))
        links[int(rest[0])].add(near)
        reached[rest[0]] = True
        stack.append(int(rest[0]))


def build_graph(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Flat arrays of the graph over distinct vectors.

    ``levels`` holds each level's place in ``nodes``; ``offsets`` and
    ``neighbours`` give the links of the node at each place of ``nodes``.  The
    levels' members are drawn with probability ``LINKS ** -level``; links go
    both ways, a node keeps the ``2 * LINKS`` shortest, and what that cuts off is
    tied on again, so that every node can be reached.
    """
    n = len(vectors)
    points = scaled_points(vectors)
    height = np.floor(-np.log(1 - np.random.default_rng(SEED).random(n)) / np.log(LINKS)).astype(int)
    nodes, offsets, neighbours, levels = [], [np.zeros(1, np.int64)], [], [0]
    for level in range(int(height.max()) + 1):
        members = np.flatnonzero(height >= level)
        own = points[members]
        links: list[set[int]] = [set() for _ in members]
        if len(members) > 1:
            for i, others in enumerate(_diverse(own, _nearest(own, CANDIDATES), LINKS)):
                for j in others.tolist():
                    links[i].add(j)
                    links[j].add(i)
        for i, others in enumerate(links):
            if len(others) > 2 * LINKS:
                near = np.array(sorted(others))
                gap = ((own[near] - own[i]) ** 2).sum(1)
                links[i] = set(near[np.argsort(gap, kind="stable")[: 2 * LINKS]].tolist())
        _connected(len(members), links, own)
        nodes.append(members)
        flat = [members[sorted(others)] for others in links]
        neighbours.extend(flat)
        offsets.append(offsets[-1][-1] + np.cumsum([len(f) for f in flat]))
        levels.append(levels[-1] + len(members))
    return {
        "nodes": np.concatenate(nodes).astype(np.int32),
        "offsets": np.concatenate(offsets).astype(np.int64),
        "neighbours": np.concatenate([*neighbours, np.zeros(0, int)]).astype(np.int32),
        "levels": np.array(levels, np.int64),
        "points": points,
    }


class Searcher:
    """Searches one graph, many queries at a time."""

    def __init__(self, graph: dict[str, np.ndarray]):
        self.points = graph["points"]
        self.half = 0.5 * np.einsum("ij,ij->i", self.points, self.points)
        self.layers = []
        for low, high in zip(graph["levels"][:-1], graph["levels"][1:], strict=True):
            members = graph["nodes"][low:high]
            degree = np.diff(graph["offsets"][low : high + 1])
            # a missing neighbour is the node itself
            table = np.repeat(members[:, None], max(1, int(degree.max())), 1)
            mask = np.arange(table.shape[1]) < degree[:, None]
            table[mask] = graph["neighbours"][graph["offsets"][low] : graph["offsets"][high]]
            place = np.full(len(self.points), -1, np.int32)
            place[members] = np.arange(len(members))
            self.layers.append((table, place))

    def _closeness(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.einsum("qd,qkd->qk", queries, self.points[nodes]) - self.half[nodes]

    def search(self, queries: np.ndarray, breadth: int) -> np.ndarray:
        """For each query ``breadth`` near nodes (-1 where there are fewer), nearest first."""
        n = len(self.points)
        queries = np.concatenate([unit_length(queries), np.zeros((len(queries), 1))], 1).astype(np.float32)
        rows = np.arange(len(queries))
        top_place = self.layers[-1][1]
        here = np.full(len(queries), int(np.flatnonzero(top_place >= 0)[0]))
        for table, place in self.layers[:0:-1]:
            moving = rows
            while len(moving):
                options = table[place[here[moving]]]
                closeness = self._closeness(queries[moving], options)
                best = closeness.argmax(1)
                now = np.einsum("qd,qd->q", queries[moving], self.points[here[moving]]) - self.half[here[moving]]
                better = closeness[np.arange(len(moving)), best] > now
                here[moving[better]] = options[np.arange(len(moving)), best][better]
                moving = moving[better]
        table, place = self.layers[0]
        beam = np.repeat(here[:, None], breadth, 1)
        close = np.full((len(queries), breadth), -np.inf, np.float32)
        done = np.ones((len(queries), breadth), bool)
        done[:, 0] = False
        close[:, 0] = self._closeness(queries, here[:, None])[:, 0]
        seen = np.zeros((len(queries), n), bool)
        seen[rows, here] = True
        active = rows
        while True:
            active = active[~done[active].all(1)]
            if not len(active):
                break
            # the nearest nodes not yet expanded; one that has been is its own neighbour and brings nothing new
            first = np.argsort(done[active], axis=1, kind="stable")[:, :EXPANDED]
            done[active[:, None], first] = True
            options = table[place[beam[active[:, None], first]]].reshape(len(active), -1)
            options = np.sort(options, axis=1)
            fresh = ~seen[active[:, None], options]
            fresh[:, 1:] &= options[:, 1:] != options[:, :-1]
            seen[active[:, None], options] = True
            closeness = np.where(fresh, self._closeness(queries[active], options), -np.inf)
            merged = np.concatenate([close[active], closeness], 1)
            order = np.argsort(-merged, axis=1, kind="stable")[:, :breadth]
            close[active] = np.take_along_axis(merged, order, 1)
            beam[active] = np.take_along_axis(np.concatenate([beam[active], options], 1), order, 1)
            state = np.concatenate([done[active], np.zeros(options.shape, bool)], 1)
            done[active] = np.take_along_axis(state, order, 1) | np.isneginf(close[active])
        return np.where(np.isneginf(close), -1, beam)


def _pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def build_index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: its graph as flat arrays, with the ids that share each vector.

    Every usable row is indexed.  Rows go to shards by a hash of their id and
    vector, so a vector that a third of all rows share is spread evenly; within
    a shard equal vectors are one node with a list of ids; rows equal in id and
    vector are dealt to shards evenly as well.  Vectors of different dimension or
    band of lengths (``length_band``, 2,100 at most) go to different shards.
    """
    rows = usable(vectors, vec_id, embedding).withColumn("band", length_band(F.col("v")))
    sizes = rows.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    before = F.sum("shards").over(Window.partitionBy("dim").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("first", F.coalesce(before, F.lit(0)).cast("int"))
    spread = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.col("shards")).cast("int")
    dealt = rows.join(F.broadcast(sizes), ["dim", "band"]).select("dim", (F.col("first") + spread).alias("shard"), "vec_id", "v")

    def build(group):
        ids = group.column("vec_id").to_numpy()
        given = np.stack(group.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
        order = np.argsort(ids, kind="stable")
        distinct, owner = np.unique(given[order], axis=0, return_inverse=True)
        owner = owner.ravel()
        by_node = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(distinct))
        graph = build_graph(distinct)
        return pa.table(
            {
                "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
                "dim": pa.array([distinct.shape[1]], pa.int32()),
                "ids": pa.array([_pack(ids[order][by_node])], pa.binary()),
                "member_offsets": pa.array([_pack(np.append(0, np.cumsum(counts)))], pa.binary()),
                "vectors": pa.array([_pack(distinct)], pa.binary()),
                **{k: pa.array([_pack(graph[k])], pa.binary()) for k in ("nodes", "offsets", "neighbours", "levels")},
            }
        )

    return dealt.groupBy("dim", "shard").applyInArrow(build, GRAPH_SCHEMA)


def _load(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, Searcher]:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    graph = {
        "nodes": np.frombuffer(row["nodes"], np.int32),
        "offsets": np.frombuffer(row["offsets"], np.int64),
        "neighbours": np.frombuffer(row["neighbours"], np.int32),
        "levels": np.frombuffer(row["levels"], np.int64),
        "points": scaled_points(vectors),
    }
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["member_offsets"], np.int64), vectors, Searcher(graph)


def _answers(loaded, query_ids: np.ndarray, numbers: np.ndarray, queries: np.ndarray, k: int, breadth: int):
    """Query, its row's number, candidate and score of the ``k`` best of one shard for each query; the query's own id is no candidate."""
    ids, offsets, vectors, searcher = loaded
    for at in range(0, len(queries), 128):
        part, own, rows = queries[at : at + 128], query_ids[at : at + 128], numbers[at : at + 128]
        nodes = searcher.search(part, max(breadth, k + 1))
        for query, me, row, found in zip(part, own, rows, nodes, strict=True):
            found = found[found >= 0]
            scores = np.einsum("ij,j->i", vectors[found], query)
            best = np.lexsort((found, -scores))
            members, values = [], []
            # members of a node stand in order of their ids, so its first k + 1 are enough
            for node, score in zip(found[best], scores[best], strict=True):
                some = ids[offsets[node] : min(offsets[node + 1], offsets[node] + k + 1)]
                members.append(some)
                values.append(np.full(len(some), score))
            if members:
                members, values = np.concatenate(members), np.concatenate(values)
                keep = members != me
                members, values = members[keep], values[keep]
                first = np.lexsort((members, -values))[:k]
                yield np.full(len(first), me), np.full(len(first), row), members[first], values[first]


def search_index(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    breadth: int = BREADTH,
    query_block: int | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best over all shards of its dimension.

    Scores are inner products in double precision; ties go to the smaller id.
    A query row that is not usable, or meets no candidate, gives no rows; a
    repeated query id gives its rows once per row.  A task holds one shard and
    one block of queries, ``QUERY_BLOCK_BYTES`` of them if ``query_block`` names
    no number; blocks are cut by hash, so their number follows the number of queries.
    """
    asked = usable(queries, vec_id, embedding).withColumnRenamed("vec_id", "query_id")
    asked = cut_lineage(asked.withColumn("number", F.monotonically_increasing_id()))
    totals = asked.agg(F.count("*").alias("n"), F.sum(8 * F.col("dim")).alias("bytes")).first()
    blocks = max(1, -(-totals["n"] // query_block) if query_block else -(-(totals["bytes"] or 0) // QUERY_BLOCK_BYTES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "number"), F.lit(blocks)).cast("int"))
    shards = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    sent = asked.join(F.broadcast(shards), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    sent = sent.drop("shards")
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look_up(graph, block):
        out = {"query_id": [], "number": [], "vec_id": [], "score": []}
        if graph.num_rows and block.num_rows:
            loaded = _load(graph.to_pylist()[0])
            ids = block.column("query_id").to_numpy()
            vectors = np.stack(block.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
            numbers = block.column("number").to_numpy()
            for columns in _answers(loaded, ids, numbers, vectors, k, breadth):
                for name, part in zip(out, columns, strict=True):
                    out[name].append(part)
        kinds = {"query_id": pa.int64(), "number": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({n: pa.array(np.concatenate(v) if v else [], kinds[n]) for n, v in out.items()})

    keys = ["dim", "shard", "block"]
    found = graphs.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(
        look_up, "query_id bigint, number bigint, vec_id bigint, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", **options
) -> DataFrame:
    """Build the index, write it to the shared folder and search it."""
    return search_index(cut_lineage(build_index(vectors, vec_id, embedding)), queries, k, vec_id, embedding, **options)
