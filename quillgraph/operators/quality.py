"""Corpus quality: missing fields, length outliers, key conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as tx


def missing_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row: blank or null count per column."""
    return rows.agg(*[F.count_if(tx.strip(tx.text_or_empty(F.col(f))) == "").alias(f) for f in fields])


def length_outliers(rows: DataFrame, field: str, short: int, long: int) -> DataFrame:
    n = F.length(tx.text_or_empty(F.col(field)))
    return rows.agg(F.count_if(n < short).alias("too_short"), F.count_if(n > long).alias("too_long"))


def key_conflicts(rows: DataFrame, field: str) -> DataFrame:
    """Rows minus distinct non-blank keys (blank keys count as conflicts).

    Two-level aggregation instead of countDistinct keeps a frequent key cheap.
    """
    keyed = rows.select(tx.strip(tx.text_or_empty(F.col(field))).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return keyed.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count_if(F.col("k") != "")).alias("conflicts")
    )


def type_counts(rows: DataFrame, field: str = "doc_type") -> DataFrame:
    return rows.groupBy(field).agg(F.count(F.lit(1)).alias("n"))
