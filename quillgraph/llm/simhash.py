"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are linked if at most ``RADIUS`` of their 64 bits differ.  Cut
into six blocks of bits, two linked fingerprints agree in two whole blocks at
least (four differences spoil four blocks at most), so only fingerprints that
share a pair of blocks are compared.  Within such a bucket the fingerprints
stand as bit planes: one machine word holds one bit of 64 of them.  A
carry-save counter over words updates 64 distances at once, and a word whose
distances have all passed the radius is given up.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.arrow import map_slices
from quillgraph.session import cut_lineage

SHINGLE = 4
SEED = 42
RADIUS = 4
#: First bit of each block, and the end.
BLOCKS = (0, 11, 22, 33, 44, 54, 64)
#: A bucket with more fingerprints is compared in parts of this size, each pair of parts in a task of its own.
PART = 8192
#: Rows of one comparison step: bounds what a task holds.
STEP_ROWS = 1 << 16

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str) -> int:
    """64-bit SimHash of a text's word shingles, as an unsigned number."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words), np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    last = min(SHINGLE, len(words)) - 1
    ends = (starts + lengths)[last:].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set; none of no hashes."""
    by_byte = hashes.view(np.uint8).reshape(-1, 8) + 256 * np.arange(8)
    votes = np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits(2 * votes > len(hashes), axis=1, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed long) of every row's whole text; a null text has no words."""
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def make():
        def apply(part: pa.RecordBatch) -> dict:
            made = np.array([fingerprint(t or "") for t in part.column("text").to_pylist()], np.uint64)
            return {"doc_id": part.column("doc_id"), "fp": pa.array(made.view(np.int64), pa.int64())}

        return apply

    return map_slices(source, "text", f"doc_id {kind}, fp bigint", make)


def _masks() -> list[int]:
    """For each pair of blocks the mask of its bits, as a signed 64-bit number."""
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(BLOCKS, BLOCKS[1:], strict=False)]
    masks = [x | y for x, y in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _buckets(fps: DataFrame) -> DataFrame:
    """``pair, key, fp`` of every fingerprint, once for each pair of blocks."""
    masks = F.array(*[F.lit(m).cast("long") for m in _masks()])
    return fps.select("fp", F.posexplode(masks).alias("pair", "mask")).select(
        F.col("pair").cast("byte").alias("pair"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )


def _dealt(buckets: DataFrame) -> DataFrame:
    """Buckets of one drop out; those over ``PART`` are dealt out as pairs of their parts."""
    sizes = buckets.groupBy("pair", "key").agg(F.count("*").alias("n")).filter(F.col("n") > PART)
    parts = F.coalesce(F.ceil(F.col("n") / PART), F.lit(1)).cast("int")
    own: Column = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        buckets.join(sizes, ["pair", "key"], "left")
        .select("pair", "key", "fp", parts.alias("parts"))
        .select("pair", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    )
    return dealt.select(
        "pair", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp"
    )


def _within(planes: np.ndarray, query: np.ndarray, word: np.ndarray, fps: np.ndarray, radius: int):
    """Lanes within the radius: rows ``(query, lanes)`` for pairs of a fingerprint and a word of 64.

    ``planes[b, w]`` has bit ``b`` of the fingerprints of word ``w``.  Three
    planes of differences enter a full adder at a time; its sum and carry run
    into a ripple of four counter planes, the last of which sticks.
    """
    rows = np.arange(len(query))
    count = [np.zeros(len(query), np.uint64) for _ in range(4)]

    def add(value: np.ndarray, place: int) -> None:
        while place < 3:
            carry = count[place] & value
            count[place] ^= value
            value, place = carry, place + 1
        count[3] |= value

    def over() -> np.ndarray:
        """Lanes whose count is above the radius (at most 7)."""
        above, equal = count[3].copy(), ~count[3]
        for place in (2, 1, 0):
            if radius >> place & 1:
                equal &= count[place]
            else:
                above |= equal & count[place]
                equal &= ~count[place]
        return above

    for low in range(0, 64, 3):
        differ = []
        for b in range(low, min(low + 3, 64)):
            bit = (fps[query[rows]] >> np.uint64(b)) & np.uint64(1)
            differ.append(planes[b, word[rows]] ^ (np.uint64(0) - bit))
        if len(differ) == 3:
            x, y, z = differ
            add(x ^ y ^ z, 0)
            add((x & y) | (z & (x ^ y)), 1)
        else:
            add(differ[0], 0)
        if low % 12 == 9:
            alive = np.flatnonzero(over() != np.uint64(0xFFFFFFFFFFFFFFFF))
            if len(alive) < len(rows):
                rows = rows[alive]
                count = [c[alive] for c in count]
            if not len(rows):
                break
    return rows, ~over() if len(rows) else np.zeros(0, np.uint64)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable through the links ``a - b`` and the labels so far."""
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]


def local_links(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the radius inside each group: fingerprints and the smallest one they reach.

    ``group`` is sorted and marks the bucket of each entry of ``fps`` (unsigned).
    """
    count = len(fps)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if count else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, count))
    words_of = -(-sizes // 64)
    first_word = np.concatenate([[0], np.cumsum(words_of)[:-1]]).astype(np.int64) if count else np.zeros(0, np.int64)
    within = np.arange(count) - np.repeat(starts, sizes)
    home = np.repeat(first_word, sizes) + within // 64
    lane = (within % 64).astype(np.uint64)
    total = int(words_of.sum())
    planes = np.zeros((64, total), np.uint64)
    for b in range(64):
        bits = ((fps >> np.uint64(b)) & np.uint64(1)) << lane
        np.bitwise_or.at(planes[b], home, bits)
    start_of_word = np.repeat(starts, words_of) + 64 * (np.arange(total) - np.repeat(first_word, words_of))
    filled = np.minimum(64, np.repeat(starts + sizes, words_of) - start_of_word)
    # every entry meets the words of its group from its own on, so each pair is compared once
    meets = np.repeat(first_word + words_of, sizes) - home
    meets[np.repeat(sizes, sizes) == 1] = 0
    label = np.arange(count)
    ends = np.cumsum(meets)
    at = 0
    while at < count:
        limit = (ends[at - 1] if at else 0) + STEP_ROWS
        stop = max(at + 1, int(np.searchsorted(ends, limit, "right")))
        n = meets[at:stop]
        query = np.repeat(np.arange(at, stop), n)
        word = np.repeat(home[at:stop], n) + np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
        rows, near = _within(planes, query, word, fps, radius)
        if len(rows):
            query, word = query[rows], word[rows]
            lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            lanes &= np.arange(64) < filled[word][:, None]
            row, column = np.nonzero(lanes)
            other = start_of_word[word[row]] + column
            apart = other > query[row]
            label = _merge(label, query[row][apart], other[apart])
        at = stop
    linked = np.flatnonzero(label != np.arange(count))
    return fps[linked], fps[label[linked]]


def _compare(batches):
    """Sorted buckets in, links out; a bucket that spans batches is carried over whole."""
    schema = ["pair", "key", "low", "high"]
    held: pa.Table | None = None

    def links(table: pa.Table) -> pa.RecordBatch:
        columns = [table.column(c).to_numpy() for c in schema]
        fps = table.column("fp").to_numpy().view(np.uint64)
        change = np.zeros(len(fps), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        a, b = local_links(np.cumsum(change), fps)
        return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < STEP_ROWS:
            continue
        last = np.ones(held.num_rows, bool)
        for c in schema:
            column = held.column(c).to_numpy()
            last &= column == column[-1]
        complete = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if complete:
            yield links(held.slice(0, complete))
            held = held.slice(complete).combine_chunks()
    if held is not None and held.num_rows:
        yield links(held)


def near_links(fps: DataFrame) -> DataFrame:
    """``a, b``: links that connect exactly what the radius connects, fewer than one per fingerprint and bucket."""
    dealt = _dealt(_buckets(fps)).repartition("pair", "key", "low", "high")
    ordered = dealt.sortWithinPartitions("pair", "key", "low", "high")
    return ordered.mapInArrow(_compare, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each linked node reaches.

    Labels hook onto smaller ones along the links and then jump to their
    label's label, until a round changes nothing.  Every round is written to
    the shared folder; a node with a third of all links is one aggregate row,
    and the joins split their hot side at run time.
    """
    links = cut_lineage(links)
    both = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    labels = cut_lineage(both.select("node", F.col("node").alias("label")))
    while True:
        ends = (
            links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
            .join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
            .filter("la <> lb")
            .select("a", "b", "la", "lb", F.least("la", "lb").alias("low"))
        )
        offers = ends.select(F.explode(F.array("a", "b", "la", "lb")).alias("node"), "low")
        lowest = offers.groupBy("node").agg(F.min("low").alias("low"))
        hooked = labels.join(lowest, "node", "left").select("node", F.least("label", "low").alias("label"))
        hooked = cut_lineage(hooked)
        onward = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = cut_lineage(hooked.join(onward, "label").select("node", F.col("next").alias("label")))
        changed = jumped.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").limit(1).count()
        labels = jumped
        if not changed:
            return labels


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``fingerprint`` is 16 lower-case hexadecimal digits, ``component_id`` the
    smallest id that links reach, the row's own included.  Texts that are null
    or without words have fingerprint zero and are linked like any other.  Rows
    with a null id take part; a component of such rows alone has a null
    ``component_id``.  Repeated rows stay; an empty table gives no rows.
    """
    rows = cut_lineage(fingerprints(documents, doc_id, text))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(near_links(nodes.select("fp")))
    labelled = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    found = labelled.join(smallest, "label").select("fp", "component_id")
    return rows.join(found, "fp").select(
        F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
