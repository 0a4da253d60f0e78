"""Bounded, order-free samples of rows for fitting a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def smallest_hashes(ids: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` distinct ids with the smallest hash: a fixed random sample, whatever the partitioning."""
    distinct = ids.select("doc_id").filter("doc_id is not null").distinct()
    return distinct.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
