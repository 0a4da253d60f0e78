"""Stupid-backoff scores of every document under counts of the whole corpus.

    S(w | v) = c(v w) / c(v)       if the bigram occurs MIN_COUNT times or more
             = BACKOFF * c(w) / N  otherwise

over ``<s> words </s>`` of each text, words being runs of other characters than
blank and the controls tab to carriage return, with A-Z lower-cased.

The count tables are partitioned by hash and the documents' n-grams are sent to
them: a bigram goes to the bucket of its first word, where its own count and
that of its context come together.  What backs off goes on to the bucket of its
second word in the table of words.  The scores return per document and are
added up.  Rows travel as packed arrays, one per bucket and slice of documents.

Words that are frequent in a sample (``HOT_SHARE`` of it or more, so at most
``1 / HOT_SHARE`` of them) would make hot buckets.  Counts of these words and of
pairs of them, taken over all documents, go with every task instead; a pair of
them is scored where it stands, and other bigrams after such a word are spread
by both words.  The sample decides the way only, not the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.arrow import slices
from quillgraph.llm.sampling import smallest_hashes
from quillgraph.session import cut_lineage

BACKOFF = 0.4
MIN_COUNT = 2
SAMPLE_DOCS = 2000
HOT_SHARE = 1 / 1000
BUCKET_ENTRIES = 1 << 19
SLICE_DOCS = 4096
SLICE_TEXT = 6 << 20

#: Word hashes have 48 bits; the two last values stand for the ends of a text.
MASK = (1 << 48) - 1
START, END = np.uint64(MASK), np.uint64(MASK - 1)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

ENTRY_SCHEMA = "bucket bigint, batch bigint, first binary, runs binary, second binary, doc binary, ids binary, words binary, sums binary"
PARTIAL_SCHEMA = "batch bigint, doc binary, sums binary, ids binary, words binary"


def word_hashes(text: str | None) -> np.ndarray:
    """48-bit hashes of a text's words between start and end; nothing for a text without words."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    inner = np.array([digest(w) & MASK for w in words], np.uint64)
    return np.concatenate([[START], np.minimum(inner, END - np.uint64(1)), [END]])


def _six(values: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first ^ (second << np.uint64(16))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def _member(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in a sorted array, and whether it is there."""
    if not len(ordered):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return place, ordered[place] == values


def _hot_words(source: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that make up ``HOT_SHARE`` of a fixed sample, and both ends."""
    chosen = smallest_hashes(source, SAMPLE_DOCS)
    sample = source.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def tally(batches):
        for batch in batches:
            hashes = np.concatenate([*map(word_hashes, batch.column("text").to_pylist()), np.zeros(0, np.uint64)])
            words, counts = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_pydict({"w": pa.array(words.astype(np.int64)), "n": pa.array(counts)})

    counted = sample.select("text").mapInArrow(tally, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = [r["w"] for r in counted.filter(F.col("n") >= HOT_SHARE * total).collect()] if total else []
    return np.unique(np.array([*hot, int(START), int(END)], np.uint64))


def _count(source: DataFrame, hot: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Counts of all words, and of all pairs of hot words (as ``place * len(hot) + place``)."""

    def tally(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_DOCS, SLICE_TEXT):
                hashes = [word_hashes(t) for t in part.column("text").to_pylist()]
                flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
                words, counts = np.unique(flat, return_counts=True)
                place, is_hot = _member(flat, hot)
                both = is_hot[:-1] & is_hot[1:] & (flat[:-1] != END)
                pairs, pair_counts = np.unique(place[:-1][both] * len(hot) + place[1:][both], return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "pair": pa.array(np.repeat([False, True], [len(words), len(pairs)])),
                        "w": pa.array(np.concatenate([words.astype(np.int64), pairs])),
                        "n": pa.array(np.concatenate([counts, pair_counts])),
                    }
                )

    counted = source.select("text").mapInArrow(tally, "pair boolean, w bigint, n bigint")
    table = cut_lineage(counted.groupBy("pair", "w").agg(F.sum("n").alias("n")))
    return table.filter("not pair").select("w", "n"), table.filter("pair").select("w", "n")


def _partial_rows(batch: np.ndarray, doc: np.ndarray, score: np.ndarray) -> dict[str, list]:
    """Scores summed per document, one row per slice of documents."""
    order = np.lexsort((doc, batch))
    batch, doc, score = batch[order], doc[order], score[order]
    starts = np.flatnonzero(np.concatenate([[True], (batch[1:] != batch[:-1]) | (doc[1:] != doc[:-1])])) if len(batch) else []
    rows: dict[str, list] = {"batch": [], "doc": [], "sums": []}
    if len(batch):
        sums, owner, docs = np.add.reduceat(score, starts), batch[starts], doc[starts]
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            rows["batch"].append(int(owner[low]))
            rows["doc"].append(docs[low:high].astype("<u2").tobytes())
            rows["sums"].append(sums[low:high].tobytes())
    return rows


def _partial_table(rows: dict[str, list], ids: list | None = None, words: list | None = None) -> pa.Table:
    n = len(rows["batch"])
    return pa.table(
        {
            "batch": pa.array(rows["batch"], pa.int64()),
            **{k: pa.array(rows[k], pa.binary()) for k in ("doc", "sums")},
            "ids": pa.array(ids or [None] * n, pa.binary()),
            "words": pa.array(words or [None] * n, pa.binary()),
        }
    )


def score_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` of every row.

    ``log_score`` adds the natural logarithms of S over a text's words and its
    end, ``mean_log_score`` divides by their number.  A null, empty or blank
    text has ``n_words`` 0, ``log_score`` 0 and a null mean, and counts nowhere.
    Repeated rows count and are scored each; the integer ids may be null.
    """
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hot = _hot_words(source)
    words, pairs = _count(source, hot)
    total = words.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_ENTRIES))
    hot_frame = documents.sparkSession.createDataFrame([(int(w),) for w in hot], "w bigint")
    known = {r["w"]: r["n"] for r in words.join(F.broadcast(hot_frame), "w").collect()}
    hot_counts = np.array([known.get(int(w), 0) for w in hot], np.float64)
    pair_rows = pairs.filter(F.col("n") >= MIN_COUNT).toArrow().sort_by("w")
    pair_keys, pair_counts = pair_rows.column("w").to_numpy(), pair_rows.column("n").to_numpy().astype(np.float64)
    shared = documents.sparkSession.sparkContext.broadcast((hot, hot_counts, pair_keys, pair_counts))

    def backed_off(count: np.ndarray) -> np.ndarray:
        return np.log(BACKOFF) + np.log(count) - np.log(total)

    def entries(batches):
        hot, hot_counts, pair_keys, pair_counts = shared.value
        batch_no = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", SLICE_DOCS, SLICE_TEXT):
                hashes = [word_hashes(t) for t in part.column("text").to_pylist()]
                flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
                lengths = np.array([len(h) for h in hashes])
                doc = np.repeat(np.arange(len(hashes)), lengths)
                inside = np.flatnonzero(flat[:-1] != END) if len(flat) else np.zeros(0, np.int64)
                first, second, doc = flat[inside], flat[inside + 1], doc[inside]
                place, first_hot = _member(first, hot)
                place_2, second_hot = _member(second, hot)
                both = first_hot & second_hot
                at, seen = _member(place[both] * len(hot) + place_2[both], pair_keys)
                kept = np.log(pair_counts[at[seen]]) - np.log(hot_counts[place[both][seen]])
                local = np.empty(len(at))
                local[seen], local[~seen] = kept, backed_off(hot_counts[place_2[both][~seen]])
                sums = np.bincount(doc[both], local, len(hashes))
                ids = part.column("doc_id")
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([-1 - batch_no], pa.int64()),
                        "batch": pa.array([batch_no], pa.int64()),
                        **{k: pa.array([None], pa.binary()) for k in ("first", "runs", "second", "doc")},
                        "ids": pa.array([ids.is_valid().to_numpy(False).tobytes() + ids.fill_null(0).to_numpy(False).tobytes()], pa.binary()),
                        "words": pa.array([np.maximum(lengths - 2, 0).astype("<i8").tobytes()], pa.binary()),
                        "sums": pa.array([sums.astype("<f8").tobytes()], pa.binary()),
                    }
                )
                first, second, doc, first_hot = (x[~both] for x in (first, second, doc, first_hot))
                spread = np.where(first_hot, _mixed(first, second), _mixed(first, np.zeros_like(first)))
                bucket = (spread % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((first, bucket))
                first, second, doc, bucket = first[order], second[order], doc[order], bucket[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
                rows: dict[str, list] = {k: [] for k in ("bucket", "first", "runs", "second", "doc")}
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    own = first[low:high]
                    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    rows["bucket"].append(int(bucket[low]))
                    rows["first"].append(_six(own[heads]))
                    rows["runs"].append(np.diff(np.append(heads, len(own))).astype("<u4").tobytes())
                    rows["second"].append(_six(second[low:high]))
                    rows["doc"].append(doc[low:high].astype("<u2").tobytes())
                n = len(rows["bucket"])
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(rows["bucket"], pa.int64()),
                        "batch": pa.array([batch_no] * n, pa.int64()),
                        **{k: pa.array(rows[k], pa.binary()) for k in ("first", "runs", "second", "doc")},
                        **{k: pa.array([None] * n, pa.binary()) for k in ("ids", "words", "sums")},
                    }
                )
                batch_no += 1

    def counted(group):
        """Entries of one bucket: slice, document, second word, score, and whether the score is still missing."""
        hot, hot_counts, _, _ = shared.value
        rows = group.to_pylist()
        runs = [np.frombuffer(r["runs"], "<u4") for r in rows]
        first = np.concatenate([np.repeat(_from_six(r["first"]), n) for r, n in zip(rows, runs, strict=True)])
        second = np.concatenate([_from_six(r["second"]) for r in rows])
        docs = [np.frombuffer(r["doc"], "<u2") for r in rows]
        batch = np.repeat(np.array([r["batch"] for r in rows]), [len(d) for d in docs])
        order = np.lexsort((second, first))
        first, second, batch, doc = first[order], second[order], batch[order], np.concatenate(docs)[order]
        new_first = np.concatenate([[True], first[1:] != first[:-1]])
        new_pair = new_first | np.concatenate([[True], second[1:] != second[:-1]])
        context = np.bincount(np.cumsum(new_first) - 1)[np.cumsum(new_first) - 1].astype(float)
        pair = np.bincount(np.cumsum(new_pair) - 1)[np.cumsum(new_pair) - 1].astype(float)
        place, is_hot = _member(first, hot)
        context[is_hot] = hot_counts[place[is_hot]]
        score = np.log(pair) - np.log(context)
        place, is_hot = _member(second, hot)
        rare = pair < MIN_COUNT
        score[rare & is_hot] = backed_off(hot_counts[place[rare & is_hot]])
        return batch, doc, second, score, rare & ~is_hot

    def scores(group):
        if group.column("bucket")[0].as_py() < 0:
            row = group.to_pylist()[0]
            docs = np.arange(len(row["sums"]) // 8).astype("<u2").tobytes()
            return _partial_table({"batch": [row["batch"]], "doc": [docs], "sums": [row["sums"]]}, [row["ids"]], [row["words"]])
        batch, doc, _, score, missing = counted(group)
        return _partial_table(_partial_rows(batch[~missing], doc[~missing], score[~missing]))

    def rest(group):
        empty = {"bucket": pa.array([], pa.int64()), **{k: pa.array([], pa.binary()) for k in ("second", "batch", "doc")}}
        if group.column("bucket")[0].as_py() < 0:
            return pa.table(empty)
        batch, doc, second, _, missing = counted(group)
        batch, doc, second = batch[missing], doc[missing], second[missing]
        bucket = (second % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((second, batch, bucket))
        bucket, batch, doc, second = bucket[order], batch[order], doc[order], second[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.table(
            {
                "bucket": pa.array([int(bucket[low]) for low, _ in spans], pa.int64()),
                "second": pa.array([_six(second[low:high]) for low, high in spans], pa.binary()),
                "batch": pa.array([batch[low:high].astype("<i8").tobytes() for low, high in spans], pa.binary()),
                "doc": pa.array([doc[low:high].astype("<u2").tobytes() for low, high in spans], pa.binary()),
            }
        )

    def from_words(asked, table):
        rows = asked.to_pylist()
        if not rows:
            return _partial_table({"batch": [], "doc": [], "sums": []})
        second = np.concatenate([_from_six(r["second"]) for r in rows])
        batch = np.concatenate([np.frombuffer(r["batch"], "<i8") for r in rows])
        doc = np.concatenate([np.frombuffer(r["doc"], "<u2") for r in rows])
        keys, counts = table.column("w").to_numpy().astype(np.uint64), table.column("n").to_numpy()
        order = np.argsort(keys)
        place, _ = _member(second, keys[order])
        return _partial_table(_partial_rows(batch, doc, backed_off(counts[order][place].astype(float))))

    def finish(group):
        rows = group.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        n_words = np.frombuffer(head["words"], "<i8")
        total = np.zeros(len(n_words))
        for r in sorted(rows, key=lambda r: (r["doc"], r["sums"])):
            total[np.frombuffer(r["doc"], "<u2")] += np.frombuffer(r["sums"], "<f8")
        valid = np.frombuffer(head["ids"][: len(n_words)], bool)
        ids = np.frombuffer(head["ids"][len(n_words) :], "<i8")
        some = n_words > 0
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=~valid),
                "n_words": pa.array(n_words, pa.int64()),
                "log_score": pa.array(total, pa.float64()),
                "mean_log_score": pa.array(total / np.maximum(n_words + 1, 1), pa.float64(), mask=~some),
            }
        )

    sent = source.mapInArrow(entries, ENTRY_SCHEMA)
    deferred = sent.groupBy("bucket").applyInArrow(rest, "bucket bigint, second binary, batch binary, doc binary")
    table = words.select(F.pmod("w", F.lit(buckets)).alias("bucket"), "w", "n")
    partial = sent.groupBy("bucket").applyInArrow(scores, PARTIAL_SCHEMA).unionByName(
        deferred.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(from_words, "batch bigint, doc binary, sums binary, ids binary, words binary")
    )
    made = partial.groupBy("batch").applyInArrow(finish, "doc_id bigint, n_words bigint, log_score double, mean_log_score double")
    return made.withColumnRenamed("doc_id", doc_id)


ORACLE = r"""
WITH given AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), marked AS (
  SELECT rid, list_concat(['<s> '], words, ['</s> ']) AS w FROM given WHERE len(words) > 0
), tokens AS (
  SELECT rid, unnest(w) AS w FROM marked
), ones AS (SELECT w, count(*) AS n FROM tokens GROUP BY w),
bigrams AS (
  SELECT rid, unnest(w[:-2]) AS v, unnest(w[2:]) AS w FROM marked
), twos AS (SELECT v, w, count(*) AS n FROM bigrams GROUP BY v, w),
scored AS (
  SELECT rid, sum(CASE WHEN t.n >= 2 THEN ln(t.n) - ln(c.n)
    ELSE ln(0.4) + ln(o.n) - ln((SELECT sum(n) FROM ones)) END) AS s
  FROM bigrams b JOIN twos t ON b.v = t.v AND b.w = t.w JOIN ones c ON c.w = b.v JOIN ones o ON o.w = b.w GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, round(s / (len(words) + 1), 6) AS mean_log_score
FROM given LEFT JOIN scored USING (rid)
"""
