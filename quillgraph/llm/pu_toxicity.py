"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives.  The text of all training rows, drawn
without regard to labels, is unlabelled: a share ``prior`` of it is toxic.  With the
sigmoid loss ``l(z) = 1 / (1 + exp(z))`` the risk of a score ``f`` is

    prior * P[l(f)] + max(0, U[l(-f)] - prior * P[l(-f)])

where P and U are means over positives and unlabelled rows.  The second term
is the risk on true negatives, which cannot be negative; when its estimate
falls below zero the step goes against it instead of fitting it further.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.arrow import map_slices
from quillgraph.llm.sampling import smallest_hashes

WORD = re.compile(r"\w+")
BITS = 18
MAX_POSITIVES = 4000
MAX_UNLABELLED = 18_000
MEMBERS = 3
STEPS = 800
RATE = 0.2
DECAY = 2e-6
MIN_POSITIVES = 3
MIN_DEVIATION = 4.0
THRESHOLD = 0.7


def features(text: str) -> np.ndarray:
    """Hashed distinct words of a text, lower-cased."""
    words = set(WORD.findall(text.lower()))
    mask = (1 << BITS) - 1
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & mask for w in words), np.int32, len(words)))


def telling(flat: np.ndarray, owner: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Words more frequent among positives than among all rows by ``MIN_DEVIATION`` standard deviations.

    A rare word fits any training set by chance; the test keeps it out, as does
    the bound of ``MIN_POSITIVES`` positives that have it.  Words that are rarer
    among positives are left out too: a text copied often is frequent in the
    unlabelled rows, and its words would speak for every copy, toxic or not.
    """
    size, n_p, n_u = 1 << BITS, positive.sum(), (~positive).sum()
    in_p = np.bincount(flat, positive[owner], size)
    in_u = np.bincount(flat, minlength=size) - in_p
    pooled = (in_p + in_u) / max(1, n_p + n_u)
    spread = np.sqrt(np.maximum(n_p * pooled * (1 - pooled) * n_u / max(1, n_p + n_u), 1e-9))
    deviation = (in_p - n_p * pooled) / spread
    return (deviation >= MIN_DEVIATION) & (in_p >= MIN_POSITIVES)


def distinct_rows(flat: np.ndarray, lengths: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its kind: near copies, told by equal minima of two hashes, are one example."""
    some = np.flatnonzero(lengths)
    starts = (np.cumsum(lengths) - lengths)[some]
    words = flat.astype(np.uint64)
    kind = np.zeros((len(lengths), 3), np.uint64)
    kind[:, 0] = positive
    for column, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 1):
        mixed = words * np.uint64(factor)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        if len(some):
            kind[some, column] = np.minimum.reduceat(mixed, starts)
    first = np.zeros(len(lengths), bool)
    first[np.unique(kind, axis=0, return_index=True)[1]] = True
    return first


def train(flat: np.ndarray, lengths: np.ndarray, positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier, by Adam steps on the risk over the telling words.

    ``flat`` holds the rows' words one after the other, ``lengths`` how many each row has.
    Rows that are near copies count once, so that no often copied text speaks for its words.
    """
    first = distinct_rows(flat, lengths, positive)
    flat = flat[np.repeat(first, lengths)]
    lengths, positive = lengths[first], positive[first]
    size, count = 1 << BITS, len(lengths)
    owner = np.repeat(np.arange(count, dtype=np.int32), lengths)
    places = np.flatnonzero(telling(flat, owner, positive))
    index = np.full(size, -1)
    index[places] = np.arange(len(places))
    column = index[flat]
    column, owner = column[column >= 0], owner[column >= 0]
    together = np.bincount(owner, minlength=count)
    part = np.bincount(column, 1 / together[owner], len(places)) / np.maximum(1, np.bincount(column, minlength=len(places)))
    # words that stand together move a score together: each takes its part of the step
    rate = RATE * np.append(part, 1)
    p, u = positive, ~positive
    share = np.where(p, prior / max(1, p.sum()), 1 / max(1, u.sum()))
    weights = np.append(np.zeros(len(places)), np.log(prior / (1 - prior)))
    mean, spread = np.zeros(len(weights)), np.zeros(len(weights))
    for step in range(1, STEPS + 1):
        score = np.bincount(owner, weights[column], count) + weights[-1]
        chance = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        as_negative = share * chance
        steep = share * chance * (1 - chance)
        slope_negative = np.where(p, -steep, steep)
        if as_negative[u].sum() >= as_negative[p].sum():
            slope = slope_negative - np.where(p, steep, 0)
        else:
            slope = -slope_negative
        gradient = np.append(np.bincount(column, slope[owner], len(places)), slope.sum())
        gradient[:-1] += DECAY * weights[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-6)
    full = np.zeros(size)
    full[places] = weights[:-1]
    return full, float(weights[-1])


def learn(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
    prior: float | None = None,
) -> tuple[np.ndarray, float]:
    """Mean weights and bias of ``MEMBERS`` classifiers, each fitted in a task of its own.

    All members share the positives and divide the unlabelled rows.  The sample
    holds the ids with the smallest hash, ``max_positives`` and
    ``max_unlabelled`` at most; an id with several texts gives the one with the
    smallest hash, an id with several labels is positive if one is 1.  Without
    ``prior`` the share of positives among the labelled rows is taken, over all
    of them.  Rows with a null id, and labels that are null, teach nothing;
    without any positive the weights are zero and the score is the prior.
    """
    source = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.filter("doc_id is not null")
    given = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    given = given.groupBy("doc_id").agg((F.max("label") == 1).alias("positive"))
    ids = source.select("doc_id").distinct().join(given, "doc_id", "left")
    if prior is None:
        seen = ids.agg(F.count("positive").alias("n"), F.sum(F.col("positive").cast("int")).alias("p")).first()
        prior = min(0.9, max(0.001, (seen["p"] or 0) / max(1, seen["n"])))
    confirmed = F.coalesce(F.col("positive"), F.lit(False))
    chosen = smallest_hashes(ids.filter(confirmed), max_positives).withColumn("positive", F.lit(True))
    others = smallest_hashes(ids, max_unlabelled).withColumn("positive", F.lit(False))
    sample = source.join(F.broadcast(chosen.union(others)), "doc_id")
    single = sample.groupBy("doc_id", "positive").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    member = F.when(F.col("positive"), F.sequence(F.lit(0), F.lit(MEMBERS - 1))).otherwise(
        F.array(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(MEMBERS)).cast("int"))
    )

    def extract():
        def apply(part: pa.RecordBatch) -> dict:
            rows = [features(t) for t in part.column("text").to_pylist()]
            return {**{k: part.column(k) for k in ("positive", "members")}, "words": pa.array(rows, pa.list_(pa.int32()))}

        return apply

    made = map_slices(
        single.select("positive", member.alias("members"), "text"),
        "text",
        "positive boolean, members array<int>, words array<int>",
        extract,
    ).select(F.explode("members").alias("member"), "positive", "words")

    def fit(group):
        positive = group.column("positive").to_numpy()
        words = group.column("words").combine_chunks()
        lengths, flat = words.value_lengths().to_numpy(), words.flatten().to_numpy()
        none = np.zeros(1 << BITS), np.log(prior / (1 - prior))
        weights, bias = train(flat, lengths, positive, prior) if positive.any() else none
        used = np.flatnonzero(weights)
        return pa.table(
            {
                "places": pa.array([used.tolist()], pa.list_(pa.int64())),
                "weights": pa.array([weights[used].tolist()], pa.list_(pa.float64())),
                "bias": pa.array([bias], pa.float64()),
            }
        )

    fitted = made.groupBy("member").applyInArrow(fit, "places array<bigint>, weights array<double>, bias double").collect()
    total, bias = np.zeros(1 << BITS), np.log(prior / (1 - prior)) * (not fitted)
    for r in fitted:
        total[np.array(r["places"], np.int64)] += np.array(r["weights"]) / len(fitted)
        bias += r["bias"] / len(fitted)
    return total, float(bias)


def score(
    documents: DataFrame, model: tuple[np.ndarray, float], doc_id: str = "doc_id", text: str = "text", with_text: bool = False
) -> DataFrame:
    """``doc_id, score`` (and the text, if ``with_text``) of every row, from its whole text alone.

    Null and empty texts get the bias's score.
    """
    weights, bias = model
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def make():
        def apply(part: pa.RecordBatch) -> dict:
            raw = np.array([weights[features(t or "")].sum() + bias for t in part.column("text").to_pylist()])
            made = {
                "doc_id": part.column("doc_id"),
                "score": pa.array(1 / (1 + np.exp(-np.clip(raw, -40, 40))), pa.float64()),
            }
            return made | {"text": part.column("text")} if with_text else made

        return apply

    kept = ", text string" if with_text else ""
    return map_slices(source, "text", f"doc_id {kind}, score double{kept}", make).withColumnRenamed("doc_id", doc_id)
