"""Language identification with hyperdimensional profiles.

Every letter has a random vector of plus and minus ones, drawn from its code
point.  An n-gram vector binds (multiplies) its letters' vectors, each permuted
(rotated) by its place; a document bundles (adds) its n-gram vectors, a
language bundles its documents.  The language with the largest cosine wins.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.arrow import map_slices

DIMENSIONS = 2048
ORDER = 3
SEED = 7
SAMPLE_PER_LANGUAGE = 2000
MAX_LANGUAGES = 1000
UNDETERMINED = "und"

CHUNK_CHARS = 1 << 20
BUNDLED_DOCS = 64
CACHED_GRAMS = 12_000


class Profiler:
    """Document vectors of one (dimensions, order, seed); n-gram vectors are kept in a bounded table."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = SEED):
        self.dimensions, self.order, self.seed = dimensions, order, seed
        self.is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[tuple[int, ...], int] = {}
        self.table = np.zeros((CACHED_GRAMS, dimensions), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions)
            if len(self.letters) >= CACHED_GRAMS:
                self.letters.clear()
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def _gram(self, codes: tuple[int, ...]) -> np.ndarray:
        vector = np.ones(self.dimensions, np.int8)
        for place, code in enumerate(codes):
            vector *= np.roll(self._letter(code), self.order - 1 - place)
        return vector

    def _symbols(self, text: str):
        """Chunks of lower-case letters' code points, a run of anything else as one 0; chunks overlap by ORDER - 1."""
        carried = np.zeros(1, np.uint32)
        for at in range(0, len(text), CHUNK_CHARS):
            codes = np.frombuffer(text[at : at + CHUNK_CHARS].lower().encode("utf-32-le", "replace"), np.uint32)
            codes = np.concatenate([carried, np.where(self.is_letter[codes], codes, 0)])
            codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
            if at + CHUNK_CHARS >= len(text) and codes[-1]:
                codes = np.append(codes, np.uint32(0))
            yield codes
            carried = codes[-(self.order - 1) :] if self.order > 1 else codes[:0]

    def _counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of the texts (one row of code points each) and how often each text has them."""
        grams, owners = [], []
        for owner, text in enumerate(texts):
            for codes in self._symbols(text):
                if len(codes) >= self.order and codes.any():
                    grams.append(np.lib.stride_tricks.sliding_window_view(codes, self.order))
                    owners.append(np.full(len(codes) - self.order + 1, owner))
        if not grams:
            return np.zeros((0, self.order), np.uint32), np.zeros((len(texts), 0), np.float32)
        windows, owner = np.concatenate(grams), np.concatenate(owners)
        present = np.flatnonzero(np.bincount(windows.ravel()))
        place = np.zeros(int(present[-1]) + 1, np.int64)
        place[present] = np.arange(len(present))
        keys = np.zeros(len(windows), np.int64)
        for column in windows.T:
            keys = keys * len(present) + place[column]
        if len(present) ** self.order <= 1 << 22:
            found = np.flatnonzero(np.bincount(keys, minlength=1))
            index = np.zeros(int(found[-1]) + 1, np.int64)
            index[found] = np.arange(len(found))
            column = index[keys]
        else:
            found, column = np.unique(keys, return_inverse=True)
        counts = np.bincount(owner * len(found) + column, minlength=len(texts) * len(found))
        parts = []
        for _ in range(self.order):
            parts.append(present[found % len(present)])
            found = found // len(present)
        return np.stack(parts[::-1], 1), counts.reshape(len(texts), -1).astype(np.float32)

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        keys = list(map(tuple, grams.tolist()))
        missing = [key for key in keys if key not in self.rows]
        if len(self.rows) + len(missing) > CACHED_GRAMS:
            self.rows.clear()
            missing = keys
        if len(missing) > CACHED_GRAMS:
            return np.stack([self._gram(key) for key in keys])
        for key in missing:
            self.table[len(self.rows)] = self._gram(key)
            self.rows[key] = len(self.rows)
        return self.table[[self.rows[key] for key in keys]]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """One vector per text, of length one; zero for a text without a letter."""
        vectors = np.zeros((len(texts), self.dimensions), np.float32)
        for at in range(0, len(texts), BUNDLED_DOCS):
            grams, counts = self._counts(texts[at : at + BUNDLED_DOCS])
            for part in range(0, len(grams), 2048):
                made = self._vectors(grams[part : part + 2048]).astype(np.float32)
                vectors[at : at + BUNDLED_DOCS] += counts[:, part : part + 2048] @ made
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return vectors / np.where(norms == 0, 1, norms)


@cache
def profiler(dimensions: int, order: int, seed: int) -> Profiler:
    """The profiler of this Python worker; its tables are bounded."""
    return Profiler(dimensions, order, seed)


def learn_prototypes(
    examples: DataFrame,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
) -> dict[str, np.ndarray]:
    """Prototype vector per language, from about ``sample_per_language`` ids of each, or all if it has fewer.

    An id is in the sample if its hash falls into the language's share, so the
    sample does not depend on order or partitioning; its size strays by the
    square root of the number.  An id with several texts teaches the one with
    the smallest hash.  Rows with a null id, text or language teach nothing.
    More than ``MAX_LANGUAGES`` languages are refused: the prototypes travel
    with every task.
    """
    rows = examples.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    ids = rows.select("lang", "doc_id").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    shares = ids.select("lang", F.least(F.lit(1.0), F.lit(sample_per_language) / F.col("n")).alias("share"))
    if shares.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    chosen = rows.join(F.broadcast(shares), "lang").filter(place < F.col("share"))
    sample = chosen.groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def add_up(batches):
        own = profiler(DIMENSIONS, ORDER, SEED)
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors = own.bundle(part.column("text").to_pylist())
                for name, vector in zip(part.column("lang").to_pylist(), vectors, strict=True):
                    totals[name] = totals.get(name, 0) + vector
        for name, total in totals.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([name]), "total": pa.array([total.tolist()], pa.list_(pa.float64()))}
            )

    partial = sample.mapInArrow(add_up, "lang string, total array<double>")
    summed = (
        partial.select("lang", F.posexplode("total").alias("i", "x"))
        .groupBy("lang", "i")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("parts"))
    )
    return {r["lang"]: np.array([p["x"] for p in r["parts"]]) for r in summed.orderBy("lang").collect()}


def identify(
    documents: DataFrame,
    prototypes: dict[str, np.ndarray],
    doc_id: str = "doc_id",
    text: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """``doc_id, lang_pred, score`` (and the text, if ``with_text``) of every row, from its text alone.

    ``score`` is the cosine with the predicted language's prototype, not below
    0.  A text that is null, empty or without a letter is ``und`` with score 0,
    as is every text when nothing was learned.  Equal cosines: the language
    first in order.  Rows are independent; ids may be null or repeat.
    """
    names = sorted(prototypes)
    stacked = np.stack([prototypes[name] for name in names]) if names else np.zeros((0, DIMENSIONS))
    stacked = (stacked / np.maximum(np.linalg.norm(stacked, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def make():
        own = profiler(DIMENSIONS, ORDER, SEED)

        def apply(part: pa.RecordBatch) -> dict:
            vectors = own.bundle([t or "" for t in part.column("text").to_pylist()])
            cosines = vectors @ stacked.T
            known = vectors.any(1) & bool(names)
            best = cosines.argmax(1) if names else np.zeros(len(vectors), int)
            score = np.clip(cosines[np.arange(len(best)), best], 0, 1) if names else np.zeros(len(vectors))
            made = {
                "doc_id": part.column("doc_id"),
                "lang_pred": pa.array([names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], pa.string()),
                "score": pa.array(np.where(known, score, 0).astype(float), pa.float64()),
            }
            return made | {"text": part.column("text")} if with_text else made

        return apply

    kept = ", text string" if with_text else ""
    found = map_slices(source, "text", f"doc_id {kind}, lang_pred string, score double{kept}", make)
    return found.withColumnRenamed("doc_id", doc_id)

