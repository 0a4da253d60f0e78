"""Streaming failure recording, idempotent per day, question and reason.

What has been recorded is a table, written day by day, and the table is the
memory: a micro-batch is compared with the keys of the days it holds and of no
other, so nothing grows inside the stream and a failure that comes weeks late
is treated like any other.  A batch writes one folder named by its number; if
it runs again after a lost driver it writes the same folder anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillgraph.functions import ids
from quillgraph.session import checkpoint_dir

NO_DAY = "unknown"


def keyed_failures(failures: DataFrame, time: str = "ts", query: str = "query", reason: str = "failure_reason") -> DataFrame:
    """Failures with their ``day`` (``unknown`` without a time) and ``failure_key``."""
    day = F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit(NO_DAY))
    return failures.withColumn("day", day).withColumn("failure_key", ids.runtime_failure_key(F.col("day"), F.col(query), F.col(reason)))


def recorded(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The recorded failures; an empty table before the first batch."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    named = [f for f in schema.fields if f.name not in ("day", "epoch")]
    full = T.StructType([*named, T.StructField("epoch", T.LongType()), T.StructField("day", T.StringType())])
    return spark.read.schema(full).option("basePath", path).parquet(path)


def record_batch(batch: DataFrame, epoch: int, path: str, time: str = "ts") -> None:
    """Write the batch's failures that no earlier batch has recorded, the earliest of each key."""
    spark = batch.sparkSession
    others = [c for c in batch.columns if c != "failure_key"]
    first = batch.groupBy("failure_key").agg(F.min(F.struct(F.col(time).alias("__time"), *[F.col(c) for c in others if c != time])).alias("row"))
    first = first.select("failure_key", F.col("row.__time").alias(time), *[f"row.{c}" for c in others if c != time]).select(*batch.columns)
    days = [r["day"] for r in batch.select("day").distinct().collect()]  # one per day in the batch
    known = recorded(spark, path, batch.schema).filter((F.col("epoch") < epoch) & F.col("day").isin(days)).select("day", "failure_key")
    fresh = first.join(known, ["day", "failure_key"], "left_anti").select(*batch.columns)
    fresh.write.mode("overwrite").partitionBy("day").parquet(f"{path.rstrip('/')}/epoch={epoch}")


def record_daily(failures: DataFrame, path: str, name: str, time: str = "ts", query: str = "query", reason: str = "failure_reason") -> StreamingQuery:
    """Record what is available: one row per day, question and reason, however late or often it comes.

    ``recorded(spark, path, schema)`` reads the table; ``keyed_failures`` has its schema.
    """
    keyed = keyed_failures(failures, time, query, reason)
    return (
        keyed.writeStream.foreachBatch(lambda batch, epoch: record_batch(batch, epoch, path, time))
        .option("checkpointLocation", f"{checkpoint_dir(failures.sparkSession).rstrip('/')}/{name}")
        .trigger(availableNow=True).start()
    )
