"""Corpus preparation: clean, structure, deduplicate, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import fixed_values as fv
from quillgraph.functions import rules
from quillgraph.functions import text as tx
from quillgraph.operators import dedup, quality
from quillgraph.session import compute_once

STRUCTURED_ROUNDS = {"round2", "round3", "round4"}
DEDUP_ROUNDS = {"round3", "round4"}


def _with_missing(rows: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit("").cast("string"))
    return rows


def _order(rows: DataFrame) -> list[str]:
    return [c for c in ("ord",) if c in rows.columns]


def prepare_statutes(rows: DataFrame, phase: str = "round3") -> DataFrame:
    rows = _with_missing(rows, ["law_name", "article_no", "chapter"])
    title = tx.strip(tx.text_or_empty(F.col("title")))
    clean = compute_once(rows, content=tx.clean_document_text(F.col("content"), title), title=title)
    found = rules.structure_statute(*[F.col(c) for c in ("title", "content", "law_name", "article_no", "chapter")])
    structured = [v.alias(k) for k, v in found.items()] if phase in STRUCTURED_ROUNDS else []
    return clean.select(
        *_order(rows), tx.strip(F.col("doc_id")).alias("doc_id"), "title", F.lit("statute").alias("source_type"), "content",
        *structured,
    )


def prepare_cases(rows: DataFrame, phase: str = "round3") -> DataFrame:
    names = ["case_id", "court", "case_type", "dispute_focus", "judgment"]
    rows = _with_missing(rows, names)
    title = tx.strip(tx.text_or_empty(F.col("title")))
    clean = compute_once(rows, content=tx.clean_document_text(F.col("content"), title), title=title)
    found = rules.structure_case(F.col("doc_id"), F.col("content"), *[F.col(c) for c in names])
    structured = [v.alias(k) for k, v in found.items()] if phase in STRUCTURED_ROUNDS else []
    return clean.select(
        *_order(rows), tx.strip(F.col("doc_id")).alias("doc_id"), "title", F.lit("case").alias("source_type"), "content",
        *structured,
    )


def prepare_faqs(rows: DataFrame, phase: str = "round3") -> DataFrame:
    rows = _with_missing(rows, ["topic"])
    structured = []
    if phase in STRUCTURED_ROUNDS:
        structured = [rules.structure_faq(F.col("topic"), F.col("question"))["topic"].alias("topic")]
    return rows.select(
        *_order(rows),
        tx.strip(F.col("faq_id")).alias("faq_id"),
        tx.clean_document_text(F.col("question")).alias("question"),
        tx.clean_document_text(F.col("answer")).alias("answer"),
        F.lit("faq").alias("source_type"),
        *structured,
    )


@dataclass
class PreparedCorpus:
    """Cleaned layers with their removal counts and quality tables (all lazy)."""

    layers: dict[str, DataFrame]
    removed: dict[str, DataFrame]
    missing: dict[str, DataFrame]
    lengths: dict[str, DataFrame]
    conflicts: dict[str, DataFrame]


def prepare_corpus(statutes: DataFrame, cases: DataFrame, faqs: DataFrame, phase: str = "round3") -> PreparedCorpus:
    """Run all three layers; deduplication applies from the third round on.

    With deduplication every input needs a unique order column ``ord``.
    """
    layers = {
        "statutes": prepare_statutes(statutes, phase),
        "cases": prepare_cases(cases, phase),
        "faqs": prepare_faqs(faqs, phase),
    }
    removed = {}
    if phase in DEDUP_ROUNDS:
        decide = {"statutes": dedup.dedup_statutes, "cases": dedup.dedup_cases, "faqs": dedup.dedup_faqs}
        for name, operator in decide.items():
            decided = operator(layers[name])
            removed[name] = dedup.removal_counts(decided)
            layers[name] = decided.filter(F.col("reason").isNull()).drop("reason")
    required = {
        "statutes": ["doc_id", "title", "law_name", "article_no", "content"],
        "cases": ["doc_id", "case_id", "title", "court", "case_type", "content"],
        "faqs": ["faq_id", "question", "answer", "topic"],
    }
    measured = {"statutes": ("content", "statute"), "cases": ("content", "case"), "faqs": ("answer", "faq")}
    keys = {"statutes": "article_no", "cases": "case_id", "faqs": "question"}
    if phase not in STRUCTURED_ROUNDS:
        return PreparedCorpus(layers, removed, {}, {}, {})
    return PreparedCorpus(
        layers,
        removed,
        {n: quality.missing_fields(layers[n], f) for n, f in required.items()},
        {n: quality.length_outliers(layers[n], c, *fv.LENGTH_LIMITS[k]) for n, (c, k) in measured.items()},
        {n: quality.key_conflicts(layers[n], c) for n, c in keys.items()},
    )
