"""Best-fit packing by minimum bin slack.

Only the lengths of pieces matter for packing, and there are at most as many
lengths as a sequence has places.  So the plan is made over a histogram: the
longest length left is taken, a bitset subset-sum over the lengths left finds
the fullest combination with it, and the combination is removed as often as it
fits.  Each task then places its own pieces by their rank within their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.arrow import map_slices
from quillgraph.llm.tokens import segment_ids
from quillgraph.session import arrow_rows, cut_lineage

CAPACITY = 2048
END_ID = 0
#: Texts that Python is handed at once.
BATCH_ROWS = 512

PIECE_SCHEMA = "piece int, start bigint, length bigint, ids_crc32 bigint, block int, rank bigint"


def fullest(counts: np.ndarray, first: int, capacity: int) -> dict[int, int]:
    """The fullest combination of available lengths that holds ``first`` and fits; length -> how often.

    Bit ``s`` of ``reach`` is set if the lengths looked at so far can sum to
    ``s``.  ``steps`` keeps the bitset before each added copy, for reading the
    combination back.  The search ends once the room is filled exactly.
    """
    room = capacity - first
    reach, limit = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int]] = []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left = int(counts[length]) - (length == first)
        for _ in range(min(left, room // length)):
            grown = (reach | reach << length) & limit
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
        if reach >> room & 1:
            break
    chosen = {first: 1}
    rest = reach.bit_length() - 1
    for length, before in reversed(steps):
        if not before >> rest & 1:
            chosen[length] = chosen.get(length, 0) + 1
            rest -= length
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows ``length, rank_from, rank_to, per_bin, sequence_from, offset`` that place every piece.

    The pieces of a length with rank in ``[rank_from, rank_to)`` go, ``per_bin``
    at a time, to the sequences from ``sequence_from`` on, one after the other
    from ``offset``.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    first = capacity
    while first:
        if not counts[first]:
            first -= 1
            continue
        chosen = fullest(counts, first, capacity)
        times = min(int(counts[length]) // n for length, n in chosen.items())
        offset = 0
        for length, n in chosen.items():
            rows.append((length, used[length], used[length] + n * times, n, sequence, offset))
            used[length] += n * times
            counts[length] -= n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def cut_pieces(
    documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its block (a task's input)."""
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def make():
        encoder = segment_ids(tokenizer)
        block = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)

        def apply(part: pa.RecordBatch) -> dict:
            owner, rows = [], []
            ids_of = encoder.encode([t or "" for t in part.column("text").to_pylist()])
            for at, ids in enumerate(ids_of):
                stream = np.append(ids, np.uint32(END_ID)).astype("<u4")
                ends = np.arange(len(stream) % capacity or capacity, len(stream) + 1, capacity)
                start = 0
                for number, end in enumerate(ends):
                    length = int(end) - start
                    rows.append((number, start, length, zlib.crc32(stream[start:end].tobytes()), block, seen[length]))
                    owner.append(at)
                    seen[length] += 1
                    start = int(end)
            columns = [np.array(column, np.int64) for column in zip(*rows, strict=True)]
            names = ["piece", "start", "length", "ids_crc32", "block", "rank"]
            made = {"doc_id": part.column("doc_id").take(pa.array(owner, pa.int64()))}
            for name, column in zip(names, columns, strict=True):
                made[name] = pa.array(column, pa.int32() if name in ("piece", "block") else pa.int64())
            return made

        return apply

    return map_slices(source, "text", f"doc_id {kind}, {PIECE_SCHEMA}", make)


def pack(
    documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``,
    one row per piece.  A null text is empty: its one piece is the closing id.
    Repeated or null ids are documents like any other; an empty table gives no
    rows.  Only a document longer than ``capacity`` is cut, its first piece
    takes the remainder.

    The driver sees one count per length (``capacity`` at most).  Ranks are
    per block and length and made global by adding the counts of the blocks
    before, so that a length shared by a third of all pieces is no hot group.
    """
    with arrow_rows(documents.sparkSession, BATCH_ROWS):
        pieces = cut_lineage(cut_pieces(documents, tokenizer, doc_id, text, capacity))
    per_block = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_bins(histogram, capacity)
    ranked = pieces.join(offsets, ["length", "block"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )
    kind = ranked.schema["doc_id"].dataType.simpleString()

    def place(batches):
        scale = np.int64(max(histogram.values(), default=0) + 1)
        keys = plan[:, 0] * scale + plan[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, length * scale + rank, "right") - 1]
            inside = rank - row[:, 1]
            yield pa.RecordBatch.from_pydict(
                {
                    **{name: batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")},
                    "sequence_id": pa.array(row[:, 4] + inside // row[:, 3], pa.int64()),
                    "offset": pa.array(row[:, 5] + inside % row[:, 3] * length, pa.int64()),
                }
            )

    placed = ranked.mapInArrow(
        place,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
    return placed.withColumnRenamed("doc_id", doc_id)
