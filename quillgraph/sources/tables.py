"""Persisted indexes and graphs as parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as tx
from quillgraph.functions import vectors as vx
from quillgraph.operators import chunking
from quillgraph.plans.answering import Graph, build_graph


def build_index(docs: DataFrame, path: str, size: int = 400, overlap: int = 80) -> dict[str, int]:
    """Chunk, hash and write one table holding chunk columns and buckets."""
    rows = chunking.chunk_documents(docs, size, overlap).withColumn("buckets", vx.text_buckets(F.col("text")))
    rows.write.mode("overwrite").parquet(path)
    written = docs.sparkSession.read.parquet(path).agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("docs")
    ).first()
    if not written["chunks"]:
        raise ValueError("no documents to index")
    return {"doc_count": written["docs"], "chunk_count": written["chunks"]}


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table; ``article`` falls back to ``article_no``."""
    rows = spark.read.parquet(path)
    given = tx.text_or_empty(F.col("article"))
    return rows.withColumn("article", F.when(given != "", given).otherwise(F.col("article_no")))


def write_graph(kg: Graph, path: str) -> dict[str, int]:
    """Write nodes, aliases, edges and mentions; edges are clustered by source for look-ups."""
    base = path.rstrip("/")
    kg.nodes.write.mode("overwrite").parquet(f"{base}/nodes")
    kg.aliases.write.mode("overwrite").parquet(f"{base}/aliases")
    kg.edges.sortWithinPartitions("source").write.mode("overwrite").parquet(f"{base}/edges")
    kg.mentions.write.mode("overwrite").parquet(f"{base}/mentions")
    kg.id_map.write.mode("overwrite").parquet(f"{base}/id_map")
    spark = kg.nodes.sparkSession
    return {n: spark.read.parquet(f"{base}/{n}").count() for n in ("nodes", "edges")}


def load_graph(spark: SparkSession, path: str) -> Graph:
    """Read a written graph; missing relation and weight get their defaults."""
    base = path.rstrip("/")
    edges = spark.read.parquet(f"{base}/edges").withColumns(
        {
            "relation": F.coalesce("relation", F.lit("MENTIONED_WITH")),
            "weight": F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")),
        }
    )
    others = {n: spark.read.parquet(f"{base}/{n}") for n in ("nodes", "aliases", "mentions", "id_map")}
    return Graph(others["nodes"], others["aliases"], edges, others["mentions"], others["id_map"])


def index_and_graph(docs: DataFrame, path: str) -> tuple[DataFrame, Graph]:
    """Load the stored index and graph, building them first where they are missing."""
    from quillgraph.sources.files import _has_files

    spark, base = docs.sparkSession, path.rstrip("/")
    if not _has_files(spark, f"{base}/chunks/_SUCCESS"):
        build_index(docs, f"{base}/chunks")
    chunks = load_index(spark, f"{base}/chunks")
    if not _has_files(spark, f"{base}/graph/edges/_SUCCESS"):
        write_graph(build_graph(chunks, "chunk_id"), f"{base}/graph")
    return chunks, load_graph(spark, f"{base}/graph")
