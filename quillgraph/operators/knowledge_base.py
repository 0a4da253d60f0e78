"""Cleaning of layered knowledge-base rows (laws, cases, FAQs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import fixed_values as fv
from quillgraph.functions import text as tx
from quillgraph.session import compute_once


def _aliased(name: str) -> Column:
    return tx.replace_all(tx.clean_text(F.col(name)), fv.ENTITY_ALIASES)


def _each(name: str, fn) -> Column:
    values = F.coalesce(F.col(name), F.array().cast("array<string>"))
    return F.filter(F.transform(values, lambda v: fn(tx.clean_text(v))), lambda v: v != "")


def clean_laws(rows: DataFrame) -> DataFrame:
    law = F.col("__law")
    return compute_once(rows, __law=tx.clean_text(F.col("law_name"))).select(
        tx.clean_text(F.col("doc_id")).alias("doc_id"),
        law.alias("law_name"),
        tx.normalize_article_name(tx.clean_text(F.col("article_no")), law).alias("article_no"),
        tx.clean_text(F.col("chapter")).alias("chapter"),
        tx.clean_text(F.col("effective_date")).alias("effective_date"),
        tx.normalize_articles_in_text(_aliased("text"), law).alias("text"),
        tx.normalize_keywords(F.col("keywords"), law).alias("keywords"),
    )


def clean_cases(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[tx.clean_text(F.col(c)).alias(c) for c in ("case_id", "case_type", "court")],
        _aliased("facts").alias("facts"),
        _each("issues", lambda v: tx.replace_all(v, fv.ENTITY_ALIASES)).alias("issues"),
        _aliased("holding").alias("holding"),
        _each("cited_laws", tx.normalize_article_name).alias("cited_laws"),
        tx.normalize_keywords(F.col("keywords")).alias("keywords"),
    )


def clean_faqs(rows: DataFrame, *keep: str) -> DataFrame:
    """FAQ columns, with any key columns named in ``keep``."""
    return rows.select(
        *keep,
        *[_aliased(c).alias(c) for c in ("question", "answer", "topic")],
        _each("related_laws", tx.normalize_article_name).alias("related_laws"),
    )
