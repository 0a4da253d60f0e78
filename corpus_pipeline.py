"""A training corpus from ``documents``: language, toxicity, near-duplicates, packing.

Every stage reads what its predecessor kept, as Parquet, and decides over all
of it.  The first three return the columns of ``documents``; the last returns
the pieces of the packed sequences.  Ids may be null or repeat: rows are judged
one by one, and near-duplicates are told apart by a row number.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bin_slack, hyperdim, pu_toxicity, shingle_copies
from quillgraph.session import arrow_rows, cut_lineage

#: A cosine as low as this is what letters without a language give.
MIN_LANGUAGE_SCORE = 0.04
#: Texts that Python is handed at once, and hands back.
BATCH_ROWS = 512


def _kept(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame], verdict: Column) -> DataFrame:
    """Rows whose judgement passes, written; a row's other columns travel through the operator as its key."""
    others = [c for c in docs.columns if c != "text"]
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        judged = judge(docs.select(F.struct(*others).alias("row"), "text"), "row")
        return cut_lineage(judged.filter(verdict).select("row.*", "text").select(*docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document goes if no language is found in its text.

    That is a text that is null or without a letter, or one whose cosine with
    every prototype is below ``MIN_LANGUAGE_SCORE``.  Prototypes are learned
    from a bounded sample of the documents that name their language.
    """
    with arrow_rows(spark, BATCH_ROWS):
        prototypes = hyperdim.learn_prototypes(docs)
    found = (F.col("lang_pred") != hyperdim.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return _kept(docs, lambda rows, key: hyperdim.identify(rows, prototypes, key, with_text=True), found)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document goes if its toxicity score, from its text alone, reaches the operator's threshold."""
    with arrow_rows(spark, BATCH_ROWS):
        model = pu_toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, lambda rows, key: pu_toxicity.score(rows, model, key, with_text=True), F.col("score") < pu_toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of near copies reach one stays: the smallest id, null last, then the first row.

    Near copies have a Jaccard similarity of 0.8 or more between their sets of five-word shingles.
    SimHash fingerprints propose them, bands of minimum hashes those beyond its radius; all are verified.
    """
    numbered = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()))
    rows = numbered.select(F.col("__row").alias("row"), F.col("text").cast("string").alias("text"))
    groups = cut_lineage(shingle_copies.copy_groups(rows)).withColumnsRenamed({"row": "__row", "group": "__group"})
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")
    named = numbered.select("__row", "doc_id").join(groups, "__row")
    stay = named.groupBy("__group").agg(F.min(order).alias("first")).select("first.__row")
    gone = cut_lineage(groups.select("__row").join(stay, "__row", "left_anti"))
    maybe, kept = shingle_copies.parted(numbered, gone, "__row")
    return kept.union(maybe.join(gone, "__row", "left_anti").select(*kept.columns)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 2048 tokens."""
    return bin_slack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each keeps stands in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-2]:
        docs = stage(spark, docs, sf_dir)
    docs = cut_lineage(drop_near_copies(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses none of the four stages.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
