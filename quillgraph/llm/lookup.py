"""Joins to a table with one row per key, and bit fields that tell which rows need one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot, so there are at most so many hot keys.
HOT_KEYS = 10_000
#: Size of a bit field; a fuller field only spares fewer rows.
FIELD_BITS = 1 << 25


def hot_lookup(rows: DataFrame, table: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` inner joined to ``table``, which has one row per key and the key's number of rows as ``size``.

    Hot keys are ``HOT_KEYS`` at most, whatever the table's size: they are sent
    to the rows, so that a key of a third of all rows is no single task.  The
    rest is joined by shuffle.  ``size`` is not returned.
    """
    total = table.agg(F.sum(size).alias("total")).first()["total"] or 0
    hot = F.col(size) * HOT_KEYS > total
    sent = F.broadcast(table.filter(hot).drop(size).withColumn("__hot", F.lit(True)))
    cold = rows.join(sent.select(*keys, "__hot"), keys, "left_anti").join(table.filter(~hot).drop(size), keys)
    return rows.join(sent, keys).drop("__hot").unionByName(cold)


def bit_field(keys: DataFrame, place: Column) -> np.ndarray:
    """A field of ``FIELD_BITS`` bits, as bytes, with the bits at ``place`` (0 to ``FIELD_BITS - 1``) of every row set."""
    spots = keys.select(place.cast("int").alias("at")).select(F.shiftright("at", 5).alias("word"), F.expr("shiftleft(1L, at & 31)").alias("bit"))
    words = spots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    field = np.zeros(FIELD_BITS // 32, np.uint32)
    field[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return field


def marked(field: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether the bit at each place is set."""
    return (field[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
