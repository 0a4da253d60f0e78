"""Streaming ingestion: files arriving in a folder become cleaned chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators import chunking
from quillgraph.session import checkpoint_dir


def document_stream(spark: SparkSession, directory: str, files_per_batch: int = 1000) -> DataFrame:
    """New text files as (doc_id, title, text)."""
    raw = (
        spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", "*.txt").load(directory)
    )
    name = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1))
    return raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), name.alias("title"), F.col("value").alias("text"))


def chunk_stream(docs: DataFrame) -> DataFrame:
    """Chunks of a document stream (a narrow, stateless plan)."""
    return chunking.chunk_documents(docs)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, path: str, name: str, mode: str = "append", rocksdb: bool = False) -> StreamingQuery:
    """Process what is available and write parquet, exactly once per micro-batch.

    ``rocksdb`` gives this query the state store that a stateful processor needs; the session keeps its own.
    """
    spark = stream.sparkSession
    writer = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", f"{checkpoint_dir(spark).rstrip('/')}/{name}")
        .trigger(availableNow=True)
    )
    if not rocksdb:
        return writer.start()
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
