"""Exact duplicates by progressive refinement.

One scan gives every row's length and the hash of its first bytes.  Rows are
grouped by length; those whose length is not alone are grouped by length and
prefix hash; only for what shares both the full content is hashed, in a second
scan, and grouped.  What a grouping leaves over is told to the next one by a bit
field of fixed size: a wrong bit costs a hash, never a result.

Texts never enter a shuffle, and a group of copies is one row per task before
the exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.arrow import map_slices
from quillgraph.llm.lookup import FIELD_BITS, bit_field, hot_lookup, marked
from quillgraph.session import cut_lineage

#: The characters that do not count.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
PREFIX_BYTES = 64
SEED = 42


def bare(text: bytes | None) -> bytes:
    """The bytes that decide whether texts are equal."""
    return (text or b"").translate(None, BLANKS)


def place_of(length: int, prefix: int) -> int:
    """A text's place in the bit field."""
    return xxhash.xxh64_intdigest(length.to_bytes(8, "little") + prefix.to_bytes(8, "little", signed=True)) % FIELD_BITS


def prefix_hash(content: bytes) -> int:
    value = xxhash.xxh64_intdigest(content[:PREFIX_BYTES], SEED)
    return value - (1 << 64) if value >> 63 else value


def _measured(texts: DataFrame) -> DataFrame:
    """``length, prefix, place`` of every text."""

    def make():
        def apply(part: pa.RecordBatch) -> dict:
            contents = [bare(t) for t in part.column("text").to_pylist()]
            lengths, prefixes = [len(c) for c in contents], [prefix_hash(c) for c in contents]
            places = [place_of(n, p) for n, p in zip(lengths, prefixes, strict=True)]
            return {"length": pa.array(lengths, pa.int64()), "prefix": pa.array(prefixes, pa.int64()), "place": pa.array(places, pa.int64())}

        return apply

    return map_slices(texts, "text", "length bigint, prefix bigint, place bigint", make)


def shared_prefixes(texts: DataFrame) -> np.ndarray:
    """Bit field of the (length, prefix hash) pairs that two rows or more share."""
    seen = cut_lineage(_measured(texts))
    lengths = seen.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1")

    def spot(length: Column) -> Column:
        return F.pmod(F.xxhash64(length), F.lit(FIELD_BITS))

    field = seen.sparkSession.sparkContext.broadcast(bit_field(lengths, spot(F.col("length"))))

    def run(batches):
        for batch in batches:
            keep = marked(field.value, batch.column("spot").to_numpy().astype(np.uint64))
            yield batch.drop_columns(["spot"]).filter(pa.array(keep))

    left = seen.withColumn("spot", spot(F.col("length"))).mapInArrow(run, seen.schema)
    pairs = left.groupBy("length", "prefix", "place").agg(F.count("*").alias("n")).filter("n > 1")
    return bit_field(pairs, F.col("place"))


def exact_groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, keep_id, group_size, kept`` of every row; with ``digest`` also the SHA-256 of every bare text.

    Texts are equal when identical without ``BLANKS``; a null text counts as
    empty.  Of a group the row with the most code points in its original text
    stays, then the smallest id, null ids last, then one row of those that are
    alike in both: of repeated rows exactly one is kept.  Rows are told apart
    by a number of their own, so ids may be null or repeat.  An empty table
    gives no rows; other columns are not read.

    Equality of what the refinement leaves is equality of SHA-256.
    """
    source = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    field = source.sparkSession.sparkContext.broadcast(shared_prefixes(source.select(F.col("text").cast("binary").alias("text"))))

    def make():
        def apply(part: pa.RecordBatch) -> dict:
            full, digests = [], []
            for content in map(bare, part.column("text").to_pylist()):
                at = np.uint64(place_of(len(content), prefix_hash(content)))
                met = bool(marked(field.value, at))
                whole = hashlib.sha256(content).digest() if met or digest else None
                full.append(whole if met else None)
                digests.append(whole.hex() if digest else None)
            return {
                "doc_id": part.column("doc_id"),
                "points": part.column("points"),
                "full": pa.array(full, pa.binary()),
                "text_sha256": pa.array(digests, pa.string()),
            }

        return apply

    scanned = source.select("doc_id", F.length("text").cast("long").alias("points"), F.col("text").cast("binary").alias("text"))
    hashed = map_slices(scanned, "text", f"doc_id {kind}, points bigint, full binary, text_sha256 string", make)
    rows = cut_lineage(hashed.withColumn("row", F.monotonically_increasing_id()))
    order = F.struct((-F.col("points")).alias("short"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    met = rows.filter("full is not null")
    groups = met.groupBy("full").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    groups = cut_lineage(groups.select("full", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"))
    found = hot_lookup(met, groups.withColumn("n", F.col("group_size")), ["full"], "n")
    alone = rows.filter("full is null").select(
        "doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    joined = found.select("doc_id", "text_sha256", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    both = joined.unionByName(alone).select(F.col("doc_id").alias(doc_id), "keep_id", "group_size", "kept", "text_sha256")
    return both if digest else both.drop("text_sha256")


ORACLE = r"""
WITH given AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
FROM given WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id NULLS LAST, rid)
"""
