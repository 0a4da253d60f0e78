"""Session set-up and the few run-time helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app_name: str = "quillgraph", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with adaptive execution switched on."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false"
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut-lineage tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without the setting (tests, a laptop) gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="quillgraph-checkpoint-")
        spark.sparkContext.setCheckpointDir(configured)
        configured = spark.sparkContext.getCheckpointDir()
    return configured


def cut_lineage(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Unlike executor-local storage the table survives lost executors, and
    reading it back as parquet keeps size statistics for the planner.  The
    tables of a session stand in one folder, see ``drop_intermediates``.

    A reader decodes thousands of rows of a file at once, so a table of very
    large rows names the most ``file_rows`` of a file.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs started inside hand Python at most so many rows at once; ten thousand large rows would not fit."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(before, most) if before > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_folder(spark: SparkSession) -> str:
    """A new path among the session's intermediates, which ``drop_intermediates`` removes."""
    return f"{_intermediates(spark)}/{uuid.uuid4().hex}"


def _intermediates(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/quillgraph-{spark.sparkContext.applicationId}"


def drop_intermediates(spark: SparkSession) -> None:
    """Remove every table this session cut lineage with; call it when no result of them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_intermediates(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


SPREAD_BYTES = 1 << 30


#: Planned bytes in a partition whose rows are taken apart after they were dealt, and the most that is believed of a plan.
DEAL_BYTES = 4 << 20
KNOWN_BYTES = 1 << 50


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def deal_by_key(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key side by side, in partitions of few bytes that are not joined at run time.

    For rows that become many more in the same task; a size the planner does not know leaves the number to it.
    """
    size = planned_bytes(df)
    if size > KNOWN_BYTES:
        return df.repartition(key)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // DEAL_BYTES)), key)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy narrow work on a small input at least one task per core.

    Only inputs the planner estimates below one gigabyte are redistributed; a
    larger table has enough splits and never pays for a shuffle here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = planned_bytes(df)
    if size > SPREAD_BYTES or df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose value is computed once per row.

    A plain projection is inlined by the optimizer wherever the column is used
    (also into filters inferred for a later explode).  A one-element generator
    keeps an expensive expression in one place at no shuffle cost.
    """
    made = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select("*", F.explode(F.array(made)).alias("__made")).select(
        *kept, *[F.col("__made")[name].alias(name) for name in columns]
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a lambda's own variable is not inlined."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def explode_rows(df: DataFrame, array: Column, name: str, position: str | None = None) -> DataFrame:
    """Explode without the size filter the optimizer would push into the scan side."""
    if position is None:
        out = df.select("*", F.posexplode_outer(array).alias("__pos", name))
        return out.filter(F.col("__pos").isNotNull()).drop("__pos")
    return df.select("*", F.posexplode_outer(array).alias(position, name)).filter(F.col(position).isNotNull())
