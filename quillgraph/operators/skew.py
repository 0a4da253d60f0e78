"""Join helpers that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_GROUP_ROWS = 100_000


def lookup_unique(
    rows: DataFrame, table: DataFrame, key: str, group_size: str, how: str = "inner", hot: int | None = HOT_GROUP_ROWS
) -> DataFrame:
    """Join ``rows`` to a table holding one row per ``key``.

    ``group_size`` is the table column with the number of rows per key.  Keys
    above ``hot`` never enter the shuffle: there are at most rows/hot of them,
    so the planner can send that part of the table to the rows.
    ``hot=None`` states that no key is hot (see ``hot_limit``).
    """
    if hot is None:
        return rows.join(table.drop(group_size), key, how)
    hot_table = table.filter(F.col(group_size) > hot)
    if hot_table.isEmpty():
        return rows.join(table.drop(group_size), key, how)
    hot_rows = rows.join(hot_table.drop(group_size), key, "inner")
    cold_rows = rows.join(hot_table.select(key), key, "left_anti")
    cold_table = table.filter(F.col(group_size) <= hot).drop(group_size)
    return cold_rows.join(cold_table, key, how).unionByName(hot_rows)


def hot_limit(df: DataFrame, *keys: str, hot: int = HOT_GROUP_ROWS) -> int | None:
    """``hot`` when some group of some key column is larger than that, else None.

    Iterative operators ask once; subsets of ``df`` cannot have larger groups.
    """
    for key in keys:
        if not df.groupBy(key).count().filter(F.col("count") > hot).isEmpty():
            return hot
    return None


def previous_value(rows: DataFrame, key: str, order: str, value: str, name: str, block: int = 10_000) -> DataFrame:
    """Add the preceding non-null ``value`` of the key, by the numeric ``order``.

    Equal to ``lag`` over the key, but a long group is sorted in blocks of the
    order column: inside a block by a window, across blocks through one last
    value per block.
    """
    blocked = rows.withColumn("__block", F.floor(F.col(order) / block))
    tails = blocked.groupBy(key, "__block").agg(F.max_by(value, order).alias("__tail"))
    carried = tails.select(
        key, "__block", F.lag("__tail").over(Window.partitionBy(key).orderBy("__block")).alias("__carried")
    )
    inside = F.lag(value).over(Window.partitionBy(key, "__block").orderBy(order))
    return (
        blocked.withColumn("__inside", inside)
        .join(carried, [key, "__block"])
        .withColumn(name, F.coalesce("__inside", "__carried"))
        .drop("__inside", "__carried", "__block")
    )
