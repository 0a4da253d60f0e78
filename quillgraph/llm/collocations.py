"""Phrases whose words belong together, from Misra-Gries summaries and an exact second pass.

A phrase is two to ``LONGEST`` words of a piece that occur ``threshold`` times or more
in a language.  Its occurrences are hashed; the hash space is cut into
partitions, and each partition merges what the tasks send into one Misra-Gries
summary.  A summary's capacity exceeds the partition's mass divided by the
threshold, so it never takes off as much as the threshold and every frequent
n-gram survives.  What survives is counted exactly, by its text, in a last scan.

Longer n-grams are looked for only where both n-grams of one word less
survived; this is told by a bit field of fixed size, whose wrong bits cost work
and never a result.  Every scan makes its n-grams anew: no list of n-grams of
the corpus is stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.arrow import slices
from quillgraph.llm.lookup import FIELD_BITS, bit_field, hot_lookup, marked
from quillgraph.session import cut_lineage

LONGEST = 5
THRESHOLD = 100
TOP = 2000
#: A candidate goes if a longer one has so many percent of its occurrences.
COVER_PERCENT = 100

#: What ends a piece, and what parts words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_ENDS = b" \t"
END, GAP = 10, 32

#: Texts are read in blocks of about this many bytes, from slices of a batch.
BLOCK = 1 << 19
SLICE_ROWS = 2048
#: Keys a task gathers before it counts them, and phrases before it sends them.
GATHERED = 1 << 20
PHRASES = 1 << 17
#: Entries of a summary; partitions are as many as their mass over the threshold needs.
CAPACITY = 1 << 16
#: Phrases that a task of the exact count adds up.
COUNTED = 1 << 16
#: Partitions are dealt to at most this many tasks, which take them one after the other.
MERGING_TASKS = 20_000
#: Parts of a language in which its first phrases are sought before its own order.
TOP_PARTS = 64

TABLE = bytes(END if c in PIECE_ENDS else GAP if c in WORD_ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
BYTE_VALUES = np.random.default_rng(13).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
FACTOR, OTHER = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` powers of an odd number and of its inverse, modulo 2**64."""
    with np.errstate(over="ignore"):
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * OTHER
    return values ^ (values >> np.uint64(32))


class Words:
    """The words of a block: where they stand, their hashes and the piece each belongs to."""

    def __init__(self, block: bytes, seed: int):
        self.block = block
        codes = np.frombuffer(block, np.uint8)
        apart = (codes == END) | (codes == GAP)
        step = np.diff(np.concatenate([[True], apart, [True]]).view(np.int8))
        self.starts, self.ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        up, down = powers(1 << max(20, len(codes).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[codes] * up[: len(codes)], dtype=np.uint64)])
        self.hashes = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] ^ np.uint64(seed))
        self.pieces = np.cumsum(codes == END)[self.starts] if len(self.starts) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, first: int, last: int) -> bytes:
        """The words from ``first`` to ``last``, with one blank between."""
        return b" ".join(filter(None, self.block[self.starts[first] : self.ends[last]].split(b" ")))


def blocks(texts: Iterator[bytes]) -> Iterator[tuple[bytes, int]]:
    """The texts as translated blocks that end between words, with the number of words each repeats of the last.

    A text that is cut has its last ``LONGEST - 1`` words before the cut again
    at the head of the next block, so that every n-gram is whole in some block.
    """
    held: list[bytes] = []
    size = 0
    for text in texts:
        if size and size + len(text) > BLOCK:
            yield b"\n".join(held), 0
            held, size = [], 0
        if len(text) <= BLOCK:
            held.append(text.translate(TABLE))
            size += len(text) + 1
            continue
        head, stop, old = 0, 0, 0
        while stop < len(text):
            block, stop = text[head : stop + BLOCK].translate(TABLE), min(stop + BLOCK, len(text))
            while stop < len(text) and block[-1] not in (END, GAP):
                more = text[stop : stop + 4096].translate(TABLE)
                cut = next((i + 1 for i, c in enumerate(more) if c in (END, GAP)), len(more))
                block, stop = block + more[:cut], stop + cut
            yield block, old
            starts = Words(block, 0).starts
            old = min(LONGEST - 1, len(starts))
            head = head + int(starts[-old]) if old else stop
    if held:
        yield b"\n".join(held), 0


def language_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), 7)


def keys_of(words: Words, order: int, old: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``n, key, whole`` for n from 1 to ``order``: the key of the n-gram from each word on.

    ``whole`` says that it stands in one piece and ends behind the repeated words.
    """
    key = mixed(words.hashes)
    for n in range(1, order + 1):
        if n > 1:
            key = mixed(key[:-1] * FACTOR + words.hashes[n - 1 :]) if len(key) > 1 else key[:0]
        count = len(key)
        whole = words.pieces[:count] == words.pieces[n - 1 : n - 1 + count]
        whole &= np.arange(n - 1, n - 1 + count) >= old
        yield n, key, whole


def place(key: np.ndarray) -> np.ndarray:
    return key % np.uint64(FIELD_BITS)


def texts_by_language(batches) -> Iterator[tuple[str, Iterator[bytes]]]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_ROWS):
            rows: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                rows.setdefault(lang, []).append(text or b"")
            yield from ((lang, iter(texts)) for lang, texts in rows.items())


def partial_counts(source: DataFrame, order: int, partitions: int, fields: list[np.ndarray]) -> DataFrame:
    """``part, keys, counts`` (packed): what the tasks' n-grams of one order come to, per partition of the hash space."""
    sent = source.sparkSession.sparkContext.broadcast(fields)

    def packed(gathered: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(gathered), return_counts=True)
        edges = np.searchsorted(keys >> np.uint64(32), np.arange(partitions + 1, dtype=np.uint64) * np.uint64(1 << 32) // np.uint64(partitions))
        edges[-1] = len(keys)
        some = np.flatnonzero(np.diff(edges))
        return pa.RecordBatch.from_pydict(
            {
                "part": pa.array(some, pa.int64()),
                "keys": pa.array([keys[edges[p] : edges[p + 1]].tobytes() for p in some], pa.binary()),
                "counts": pa.array([counts[edges[p] : edges[p + 1]].astype("<u4").tobytes() for p in some], pa.binary()),
            }
        )

    def run(batches):
        gathered, size = [], 0
        shorter = sent.value[order - 2] if order > 1 else None
        for lang, texts in texts_by_language(batches):
            seed = language_seed(lang)
            for block, old in blocks(texts):
                before = None
                for n, key, whole in keys_of(Words(block, seed), order, old):
                    if n < order - 1:
                        continue
                    if n == order:
                        if n > 1:
                            whole &= before[: len(key)] & before[1 : len(key) + 1]
                        gathered.append(key[whole])
                        size += len(gathered[-1])
                    else:
                        before = marked(shorter, place(key))
                if size >= GATHERED:
                    yield packed(gathered)
                    gathered, size = [], 0
        if size:
            yield packed(gathered)

    return source.mapInArrow(run, "part bigint, keys binary, counts binary")


class Summary:
    """A Misra-Gries summary that takes weighted keys and never takes off ``threshold`` from one.

    ``taken`` is what has been taken off every key at most.  If a partition has
    more mass than it was planned for, so that the next cut would reach the
    threshold, the capacity doubles instead: it keeps exceeding mass / threshold.
    """

    def __init__(self, threshold: int, capacity: int):
        self.threshold, self.capacity, self.taken = threshold, capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting_size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.waiting_size += len(keys)
        if self.waiting_size >= self.capacity:
            self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.waiting_size = [], 0
        self.keys, own = np.unique(keys, return_inverse=True)
        self.counts = np.zeros(len(self.keys), np.int64)
        np.add.at(self.counts, own, counts)
        while len(self.keys) > self.capacity:
            at = len(self.keys) - self.capacity - 1
            cut = int(np.partition(self.counts, at)[at])
            if self.taken + cut >= self.threshold:
                self.capacity *= 2
                continue
            self.taken += cut
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut

    def survivors(self) -> np.ndarray:
        """Keys whose count may have reached the threshold."""
        self._merge()
        return self.keys[self.counts + self.taken >= self.threshold]


def surviving(partial: DataFrame, threshold: int, partitions: int, capacity: int = CAPACITY) -> DataFrame:
    """``key`` of all n-grams that may be frequent: no frequent one is missing."""

    def run(batches):
        part, summary = None, None

        def out():
            return pa.RecordBatch.from_pydict({"key": pa.array(summary.survivors().view(np.int64), pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if summary:
                        yield out()
                    part, summary = row["part"], Summary(threshold, capacity)
                summary.add(np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], "<u4").astype(np.int64))
        if summary:
            yield out()

    dealt = partial.repartition(min(partitions, MERGING_TASKS), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "key bigint")


def exact_counts(source: DataFrame, longest: int, fields: list[np.ndarray]) -> DataFrame:
    """``lang, phrase, n_words, n`` of the n-grams marked in the fields; an empty phrase has all words of its language.

    Tasks send what they counted in one row per language and part of the
    phrases; a part is added up by one task.
    """
    sent = source.sparkSession.sparkContext.broadcast(fields)
    parts = 16 + sum(int(np.bitwise_count(f).sum()) for f in fields) // COUNTED

    def packed(found: dict[tuple[str, bytes], int]) -> pa.RecordBatch:
        lists: dict[tuple[int, str], tuple[list[bytes], list[int]]] = {}
        for (lang, phrase), count in found.items():
            phrases, counts = lists.setdefault((xxhash.xxh64_intdigest(phrase) % parts, lang), ([], []))
            phrases.append(phrase)
            counts.append(count)
        return pa.RecordBatch.from_pydict(
            {
                "part": pa.array([p for p, _ in lists], pa.int32()),
                "lang": pa.array([lang for _, lang in lists], pa.string()),
                "phrases": pa.array([b"\n".join(phrases) for phrases, _ in lists.values()], pa.binary()),
                "counts": pa.array([np.array(counts, "<i8").tobytes() for _, counts in lists.values()], pa.binary()),
            }
        )

    def count(batches):
        found: dict[tuple[str, bytes], int] = {}
        for lang, texts in texts_by_language(batches):
            seed = language_seed(lang)
            for block, old in blocks(texts):
                words = Words(block, seed)
                found[lang, b""] = found.get((lang, b""), 0) + max(0, len(words) - old)
                for n, key, whole in keys_of(words, longest, old):
                    at = np.flatnonzero(whole)
                    at = at[marked(sent.value[n - 1], place(key[at]))]
                    _, first, counts = np.unique(key[at], return_index=True, return_counts=True)
                    for start, times in zip(at[first].tolist(), counts.tolist(), strict=True):
                        name = (lang, words.text(start, start + n - 1))
                        found[name] = found.get(name, 0) + times
                if len(found) >= PHRASES:
                    yield packed(found)
                    found = {}
        yield packed(found)

    def add(batches):
        part, total = None, {}

        def out():
            langs, phrases = zip(*total, strict=True)
            sizes = [p.count(b" ") + 1 if p else 0 for p in phrases]
            columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(sizes, pa.int32()), pa.array(total.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n_words", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if total:
                        yield out()
                    part, total = row["part"], {}
                for phrase, times in zip(row["phrases"].split(b"\n"), np.frombuffer(row["counts"], "<i8").tolist(), strict=True):
                    total[row["lang"], phrase] = total.get((row["lang"], phrase), 0) + times
        if total:
            yield out()

    counted = source.mapInArrow(count, "part int, lang string, phrases binary, counts binary")
    dealt = counted.repartition(min(parts, MERGING_TASKS), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(add, "lang string, phrase binary, n_words int, n bigint")


def frequent_ngrams(
    documents: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, capacity: int = CAPACITY
) -> DataFrame:
    """``lang, phrase, n_words, n``: every n-gram up to ``longest`` words that occurs ``threshold`` times or more in its language.

    The row with an empty phrase has the number of all words of the language.
    """
    source = documents.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text")
    )
    most = source.agg(F.sum(F.floor((F.octet_length("text") + 1) / 2)).alias("words")).first()["words"] or 0
    partitions = most // (threshold * capacity) + 1
    fields: list[np.ndarray] = []
    for order in range(1, longest + 1):
        kept = surviving(partial_counts(source, order, partitions, fields), threshold, partitions, capacity)
        fields.append(bit_field(kept, F.pmod(F.col("key"), F.lit(FIELD_BITS))))
    counted = exact_counts(source, longest, fields)
    return counted.filter((F.col("n") >= threshold) | (F.col("n_words") == 0)).select("lang", F.col("phrase").cast("string").alias("phrase"), "n_words", "n")


def collocations(
    documents: DataFrame,
    text: str = "text",
    lang: str = "lang",
    threshold: int = THRESHOLD,
    top: int = TOP,
    cover_percent: int = COVER_PERCENT,
    longest: int = LONGEST,
    capacity: int = CAPACITY,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of every language.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of the
    cut with the lowest ``floor(1000 * a * n / (l * r))`` (ties: the earliest
    cut), ``n`` the words of the language.  A phrase goes if a longer one that
    holds it has ``cover_percent`` of its occurrences.  Order: score and ``a``
    falling, then the phrase's bytes.

    A null language is ``und``, a null text empty.  Repeated documents count
    every time; an empty table gives no rows; other columns are not read.
    Numbers are exact: products are decimals of 38 digits.
    """
    counted = cut_lineage(frequent_ngrams(documents, text, lang, threshold, longest, capacity))
    ngrams = counted.filter("n_words > 0").select("lang", "phrase", "n_words", F.col("n").alias("a"))
    totals = counted.filter("n_words = 0").select("lang", "n")
    phrases = ngrams.filter("n_words > 1").withColumn("words", F.split("phrase", " "))

    held = phrases.filter("n_words > 2").select("lang", "words", "a", "n_words", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("size"))
    held = held.select("lang", "words", "a", "size", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)).alias("at"))
    held = held.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), "a")
    longer = held.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    free = phrases.join(longer, ["lang", "phrase"], "left").filter(
        F.col("held").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("held") < F.lit(cover_percent).cast("decimal(20,0)") * F.col("a"))
    )
    free = cut_lineage(free.select("lang", "phrase", "words", "n_words", "a"))

    cuts = free.select("lang", "phrase", "words", "n_words", "a", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cut_lineage(
        cuts.select(
            "lang", "phrase", "a", "k",
            F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
            F.array_join(F.slice("words", F.col("k") + 1, F.col("n_words")), " ").alias("rest"),
        )
    )

    def counts_of(part: str, name: str) -> DataFrame:
        """The counts of the parts that occur, with the number of rows that ask for each."""
        asked = cuts.groupBy("lang", part).agg(F.count("*").alias("asking"))
        own = ngrams.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
        return cut_lineage(asked.join(own, ["lang", part]))

    valued = hot_lookup(cuts, counts_of("first", "l"), ["lang", "first"], "asking")
    valued = hot_lookup(valued, counts_of("rest", "r"), ["lang", "rest"], "asking")
    n_of = totals.join(cuts.groupBy("lang").agg(F.count("*").alias("asking")), "lang")
    valued = hot_lookup(valued, cut_lineage(n_of), ["lang"], "asking")
    score = F.expr("(cast(cast(a as decimal(15,0)) * 1000 as decimal(18,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = (
        valued.withColumn("score", score)
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))
    early = lowest.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    early = early.filter(F.col("rank") <= top)
    ranked = early.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH given AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM given)
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
), ngrams AS (
  SELECT lang, phrase, m, count(*) AS a FROM (
    SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase
    FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM (SELECT *, unnest(range(1, 6)) AS m FROM pieces))
  ) GROUP BY lang, phrase, m HAVING count(*) >= 100
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS words FROM ngrams WHERE m > 1
), longer AS (
  SELECT lang, array_to_string(words[pos : pos + size - 1], ' ') AS phrase, max(a) AS held
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS pos FROM (SELECT *, unnest(range(2, m)) AS size FROM candidates)) GROUP BY 1, 2
), free AS (
  SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, phrase) WHERE held IS NULL OR 100 * held < 100 * a
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(words[1 : k], ' ') AS head, array_to_string(words[k + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM free)
), valued AS (
  SELECT c.lang, c.phrase, c.a, c.k, f.a AS l, g.a AS r, n, ((1000::HUGEINT * c.a * n) // (f.a::HUGEINT * g.a))::BIGINT AS score
  FROM cuts c JOIN totals USING (lang) JOIN ngrams f ON f.lang = c.lang AND f.phrase = head JOIN ngrams g ON g.lang = c.lang AND g.phrase = rest
), lowest AS (
  SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
) WHERE rank <= 2000
"""
