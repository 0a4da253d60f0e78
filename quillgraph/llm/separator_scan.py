"""Token counts by scanning flat token files for the end-of-document id.

A token file is nothing but little-endian ids, one after the other, each
document closed by the end id; there is no index.  Files are cut into blocks
of bytes that tasks search independently.  What a block cannot know, how many
documents end before it and where the last one did, comes from a prefix scan
over the blocks' summaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.arrow import map_slices
from quillgraph.llm.tokens import segment_ids
from quillgraph.session import cut_lineage

BLOCK_BYTES = 4 << 20


def write_token_files(documents: DataFrame, tokenizer: str, end_id: int, path: str, width: int = 2, text: str = "text") -> None:
    """Write the ids of every text, each closed by ``end_id``, to flat files below ``path``.

    ``width`` is the bytes of one id.  Spark's text writer does the writing
    (row after row, with the end id's bytes as separator), so its commit
    protocol covers lost executors.  A null text is an empty document.  Ids
    that do not fit the width, or that equal ``end_id``, are refused; a special
    token's string in a text is ordinary text, so that it ends no document.
    """
    source = documents.select(F.col(text).cast("string").alias("text"))

    def make():
        encoder = segment_ids(tokenizer, plain_specials=True)

        def apply(part: pa.RecordBatch) -> dict:
            rows = []
            for ids in encoder.encode([t or "" for t in part.column("text").to_pylist()]):
                if len(ids) and (int(ids.max()) >> 8 * width or (ids == end_id).any()):
                    raise ValueError("an id is too wide or equals the end id")
                rows.append(ids.astype(f"<u{width}").tobytes())
            return {"ids": pa.array(rows, pa.binary())}

        return apply

    separator = end_id.to_bytes(width, "little").decode("latin-1")
    rows = map_slices(source, "text", "ids binary", make).select(F.col("ids").cast("string").alias("value"))
    rows.write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def _read(path: str, offset: int, length: int) -> bytes:
    """A byte range through the file system that the path names."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as source:
        return source.read_at(length, offset)


def scan_separators(
    spark: SparkSession, path: str, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document of the token files below ``path``.

    Returns ``file`` (its path), ``doc_no`` (from 0 in each file), ``start``
    (tokens before it in the file), ``n_tokens`` (without the end id) and
    ``closed``: false for tokens after a file's last end id.  Empty documents
    count 0 tokens, empty files give no rows.  A file whose size is no multiple
    of ``width`` is refused.

    Tasks hold one block each, whatever the length of files and documents.
    The prefix scan sees one row per block that has an end id.
    """
    block_bytes -= block_bytes % width
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").filter("length > 0")
    blocks = files.select(
        "file", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block_bytes))).alias("block")
    ).repartition("file", "block")

    def search(batches):
        for batch in batches:
            for file, length, block in zip(*[batch.column(c).to_pylist() for c in ("file", "length", "block")], strict=True):
                if length % width:
                    raise ValueError(f"{file} does not hold whole ids")
                begin = block * block_bytes
                ids = np.frombuffer(_read(file, begin, min(block_bytes, length - begin)), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + begin // width
                for at in range(0, len(ends), 1 << 16):
                    own = ends[at : at + (1 << 16)]
                    before = np.concatenate([ends[at - 1 : at] if at else [-1], own[:-1]])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file": pa.array([file] * len(own), pa.string()),
                            "block": pa.array(np.full(len(own), block, np.int64)),
                            "place": pa.array(np.arange(at, at + len(own))),
                            "ends": pa.array(own, pa.int64()),
                            "before": pa.array(before, pa.int64()),
                        }
                    )

    found = cut_lineage(
        blocks.mapInArrow(search, "file string, block bigint, place bigint, ends bigint, before bigint")
    )
    summary = found.groupBy("file", "block").agg(F.count("*").alias("n"), F.max("ends").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    prefix = summary.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("last_before"),
    )
    start = F.when(F.col("before") >= 0, F.col("before")).otherwise(F.col("last_before")) + 1
    closed = found.join(prefix, ["file", "block"]).select(
        "file",
        (F.col("docs_before") + F.col("place")).alias("doc_no"),
        start.alias("start"),
        (F.col("ends") - start).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    totals = summary.groupBy("file").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    tail = F.coalesce(F.col("last"), F.lit(-1)) + 1
    rest = (
        files.join(totals, "file", "left")
        .select(
            "file",
            F.coalesce("n", F.lit(0)).alias("doc_no"),
            tail.alias("start"),
            (F.col("length") / width - tail).cast("long").alias("n_tokens"),
            F.lit(False).alias("closed"),
        )
        .filter("n_tokens > 0")
    )
    return closed.unionByName(rest)
