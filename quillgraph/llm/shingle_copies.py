"""Near copies by the Jaccard similarity of word shingles, verified exactly.

Candidates come from SimHash fingerprints of the sets within the radius of
``simhash``.  Those reach down to a similarity of about 0.95: about ten of 64
bits differ at 0.8, and blocks for a radius of ten or more meet nearly
everything.  What lies between comes from bands of minimum hashes: two texts
whose sets of shingles have similarity ``s`` share a band with probability
``1 - (1 - s**DEPTH)**BANDS``, which is 0.99997 at 0.8.  Every candidate is
verified on the whole sets.

Texts with equal sets are one node.  Members of a band first meet only the
band's smallest node, so a large group of copies costs one comparison each.
Bands that still hold several components go to tasks whole, in parts of bounded
size, as sets of hashes.  There two sets meet only if they share one of the
first fifth of their hashes, rarest first, as sets of similarity 0.8 must, and
only until they are connected; a part sends on a spanning forest, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.arrow import map_slices
from quillgraph.llm.lookup import hot_lookup
from quillgraph.llm.simhash import LOWER, components, majority, near_links
from quillgraph.session import arrow_rows, cut_lineage

SHINGLE = 5
#: Similarity from which texts are copies, as numerator and denominator.
SIMILAR = (4, 5)
BANDS = 20
DEPTH = 4
SEED = 42
#: Hashes and sets in one part of a band.
PART_HASHES = 1 << 18
PART_ROWS = 4096
#: Members of one centre that a task compares with it.
CENTRE_ROWS = 4096
#: Texts or sets that Python is handed at once.
BATCH_ROWS = 512
#: Size of the bit field that spares most rows a shuffle; a fuller field only spares fewer.
FIELD_BITS = 1 << 25

FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, (BANDS * DEPTH, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    starts = (ends - lengths).tolist()
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[last:].tolist())], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set; none for an empty one."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full((BANDS * DEPTH, 1), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        mixed = (hashes[at : at + 1024] ^ (hashes[at : at + 1024] >> np.uint64(31)))[None, :] * FACTORS
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, mixed.min(1, keepdims=True), out=least)
    keys = least.reshape(BANDS, DEPTH)
    return np.array([xxhash.xxh64_intdigest(key.tobytes(), at) for at, key in enumerate(keys)], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = SIMILAR) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``least``; empty sets are equal."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * least[1] >= least[0] * (len(a) + len(b) - shared)


def _sketches(rows: DataFrame) -> DataFrame:
    """``row, high, low, size, fp, keys``: 128 bits that stand for the set, its size, its SimHash and its bands."""

    def make():
        def apply(part: pa.RecordBatch) -> dict:
            sets = [shingles(t or "") for t in part.column("text").to_pylist()]
            marks = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            keys = [bands(s) for s in sets]
            ends = np.append(0, np.cumsum([len(k) for k in keys]))
            flat = pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))
            return {
                "row": part.column("row"),
                "high": pa.array(marks[:, 0]),
                "low": pa.array(marks[:, 1]),
                "size": pa.array([len(s) for s in sets], pa.int64()),
                "fp": pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)),
                "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
            }

        return apply

    return map_slices(rows, "text", "row bigint, high bigint, low bigint, size bigint, fp bigint, keys array<bigint>", make)


def parted(rows: DataFrame, ids: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """Rows that may be among ``ids`` and rows that are not, told by one bit of a field of fixed size.

    Python sees the places of the bits alone; texts stay where they are.
    """
    place = F.pmod(F.xxhash64(F.col(row)), F.lit(FIELD_BITS))
    spots = ids.select(place.alias("at")).select(F.shiftright("at", 5).cast("int").alias("word"), (F.col("at") % 32).cast("int").alias("bit"))
    set_bits = spots.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    field = np.zeros(FIELD_BITS // 32, np.uint32)
    field[set_bits.column("word").to_numpy()] = set_bits.column("bits").to_numpy().astype(np.uint32)
    sent = rows.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("boolean")
    def found(at: pd.Series) -> pd.Series:
        spot = at.to_numpy()
        return pd.Series((sent.value[spot >> 5] >> (spot & 31).astype(np.uint32) & np.uint32(1)).astype(bool))

    told = rows.withColumn("__found", found(place))
    return told.filter("__found").drop("__found"), told.filter("not __found").drop("__found")


def _may_be_similar(a: Column, b: Column) -> Column:
    """Sets of these sizes can reach the similarity."""
    return SIMILAR[1] * F.least(a, b) >= SIMILAR[0] * F.greatest(a, b)


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """``a, b`` of ``node, size, fp``: the first node of a fingerprint with its others and with the first of each linked fingerprint."""
    first = F.min(F.struct("node", "size")).alias("first")
    firsts = nodes.groupBy("fp").agg(F.count("*").alias("n"), first)
    firsts = cut_lineage(firsts.select("fp", "n", F.col("first.node").alias("a"), F.col("first.size").alias("a_size")))
    same = hot_lookup(nodes, firsts.filter("n > 1"), ["fp"], "n").select("a", "a_size", "node", "size")
    links = cut_lineage(near_links(firsts.select("fp"))).withColumnsRenamed({"a": "fp", "b": "least"})
    centres = firsts.select(F.col("fp").alias("least"), "a", "a_size")
    ends = firsts.select("fp", F.col("a").alias("node"), F.col("a_size").alias("size"))
    across = links.join(ends, "fp").join(centres, "least").select("a", "a_size", "node", "size")
    pairs = same.unionByName(across).filter("a <> node").filter(_may_be_similar(F.col("size"), F.col("a_size")))
    return pairs.select("a", F.col("node").alias("b"))


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of rows that are similar.

    A task holds the set of one ``a`` and streams its ``b`` past it; an ``a``
    with many pairs is copied to several tasks.
    """
    centres = cut_lineage(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / CENTRE_ROWS).cast("int")))
    dealt = hot_lookup(pairs, centres, ["a"], "n").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    members = dealt.join(texts.withColumnRenamed("row", "b"), "b").select("a", "part", "b", "text")
    held = centres.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = held.join(texts.withColumnRenamed("row", "a"), "a").select("a", "part", F.lit(None).cast("bigint").alias("b"), "text")
    order = F.col("b").asc_nulls_first()
    ready = held.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", order)

    def run(batches):
        own = None
        for batch in batches:
            found_a, found_b = [], []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text"), strict=True):
                hashes = shingles(text.as_py() or "")
                if b is None:
                    own = hashes
                elif similar(own, hashes):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_pydict({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return ready.mapInArrow(run, "a bigint, b bigint")


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def forest(labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between labels that join exactly what similar sets of different sides join.

    With one side only, all sets meet.  Two sets are looked at if they share
    one of their rarest ``1 - 0.8`` hashes, have sizes that allow it and no
    common label yet.
    """
    count, across = len(sets), len(np.unique(sides)) > 1
    sizes = np.array([len(s) for s in sets], np.int64)
    names, own = np.unique(labels, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    member = np.repeat(np.arange(count), sizes)
    _, token, frequency = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    rarest = np.lexsort((token, frequency[token], member))
    needed = sizes * (SIMILAR[1] - SIMILAR[0]) // SIMILAR[1] + 1
    early = rarest[np.arange(len(rarest)) - starts[member] < needed[member]]
    early = early[frequency[token[early]] > 1]
    early_of = np.searchsorted(member[early], np.arange(count + 1))

    def postings(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = places[np.argsort(token[places], kind="stable")]
        return member[order], np.searchsorted(token[order], np.arange(len(frequency) + 1))

    early_members, early_at = postings(early)
    all_members, all_at = postings(np.arange(len(token)))
    links = []
    for x in range(count):
        mine = token[early[early_of[x] : early_of[x + 1]]]
        others = np.unique(early_members[_runs(early_at[mine], early_at[mine + 1] - early_at[mine])])
        others = others[(others > x) & (own[others] != own[x])]
        if across:
            others = others[sides[others] != sides[x]]
        low, high = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        others = others[SIMILAR[1] * low >= SIMILAR[0] * high]
        if not len(others):
            continue
        whole = token[starts[x] : starts[x] + sizes[x]]
        shared = np.bincount(all_members[_runs(all_at[whole], all_at[whole + 1] - all_at[whole])], minlength=count)[others]
        for y in others[shared * SIMILAR[1] >= SIMILAR[0] * (sizes[x] + sizes[others] - shared)].tolist():
            if own[y] != own[x]:
                links.append((int(names[own[x]]), int(names[own[y]])))
                own[own == own[y]] = own[x]
    return links


def _forests(parts: DataFrame) -> DataFrame:
    """``a, b``: links between the labels of sets that stand in one part (``key, low, high``)."""

    def run(batches):
        last, rows = None, []

        def links():
            labels, sides, sets = zip(*rows, strict=True)
            made = forest(np.array(labels), np.array(sides), list(sets))
            a, b = zip(*made, strict=True) if made else ((), ())
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "low", "high", "label", "own")]
            for key, low, high, label, own, hashes in zip(*columns, batch.column("hashes"), strict=True):
                if last != (key, low, high):
                    if rows:
                        yield links()
                    last, rows = (key, low, high), []
                rows.append((label, own, np.frombuffer(hashes.as_buffer(), "<u8").copy()))
        if rows:
            yield links()

    ready = parts.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return ready.select("key", "low", "high", "label", "own", "hashes").mapInArrow(run, "a bigint, b bigint")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose number is wanted, written once."""
    return cut_lineage(parted(rows, wanted, "row")[0].join(wanted, "row", "left_semi"))


def _sets(texts: DataFrame) -> DataFrame:
    """``node, hashes`` of texts."""

    def make():
        def apply(part: pa.RecordBatch) -> dict:
            made = [shingles(t or "").tobytes() for t in part.column("text").to_pylist()]
            return {"node": part.column("row"), "hashes": pa.array(made, pa.binary())}

        return apply

    return map_slices(texts, "text", "node bigint, hashes binary", make)


def _open_links(others: DataFrame, labels: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame | None:
    """Links between labels inside the bands that still hold more than one; None if there is no such band."""
    named = others.join(labels, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))
    bands_left = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), F.sum("size").alias("hashes"))
    bands_left = bands_left.filter("least <> most").select(
        "key", "n", F.greatest(F.ceil(F.col("hashes") / PART_HASHES), F.ceil(F.col("n") / PART_ROWS)).cast("int").alias("parts")
    )
    left = cut_lineage(hot_lookup(named, cut_lineage(bands_left), ["key"], "n"))
    if left.isEmpty():
        return None
    wanted = cut_lineage(left.select(F.col("node").alias("row")).distinct())
    unread = wanted.join(texts.select("row"), "row", "left_anti")
    read = texts.join(wanted, "row", "left_semi")
    sets = cut_lineage(_sets(read).unionByName(_sets(_texts(rows, unread))))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = left.select("key", "node", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    parts = dealt.select("key", "node", "label", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return cut_lineage(_forests(parts.join(sets, "node")))


def copy_groups(rows: DataFrame) -> DataFrame:
    """``row, group`` of the rows that have a copy: the smallest row that links of similar texts reach.

    ``rows`` has ``row`` (bigint, distinct) and ``text``.  Null texts have no words, like empty ones; all of these are one group.
    """
    with arrow_rows(rows.sparkSession, BATCH_ROWS):
        return _copy_groups(rows)


def _copy_groups(rows: DataFrame) -> DataFrame:
    sketches = cut_lineage(_sketches(rows))
    nodes = cut_lineage(sketches.groupBy("high", "low").agg(F.min("row").alias("node"), F.count("*").alias("n")))
    alone = sketches.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    met = alone.select(F.col("row").alias("node"), "size", F.explode("keys").alias("key"))
    first = F.min(F.struct("node", "size")).alias("first")
    shared = met.groupBy("key").agg(F.count("*").alias("n"), first).filter("n > 1")
    shared = cut_lineage(shared.select("key", "n", F.col("first.node").alias("centre"), F.col("first.size").alias("centre_size")))
    others = cut_lineage(hot_lookup(met, shared, ["key"], "n").filter("node <> centre"))
    pairs = others.filter(_may_be_similar(F.col("size"), F.col("centre_size")))
    proposed = _by_fingerprint(alone.filter("size > 0").select(F.col("row").alias("node"), "size", "fp"))
    pairs = cut_lineage(proposed.unionByName(pairs.select(F.col("centre").alias("a"), F.col("node").alias("b"))).distinct())
    texts = _texts(rows, cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()))
    labels = components(_near(pairs, texts))
    links = _open_links(others, labels, texts, rows)
    linked = nodes.join(labels, "node", "left").select("high", "low", "n", F.coalesce("label", "node").alias("label"), F.col("label").isNotNull().alias("met"))
    if links is not None:
        onward = components(links).select(F.col("node").alias("label"), F.col("label").alias("onward"))
        linked = linked.join(onward, "label", "left").select(
            "high", "low", "n", F.coalesce("onward", "label").alias("label"), (F.col("met") | F.col("onward").isNotNull()).alias("met")
        )
    linked = linked.filter("n > 1 or met").withColumnRenamed("label", "group")
    return hot_lookup(sketches.select("row", "high", "low"), linked, ["high", "low"], "n").select("row", "group")
