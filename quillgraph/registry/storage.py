"""Queries that go through a sink, an index or a stream and read the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph.operators import feedback, knowledge_base
from quillgraph.registry import dialogue, reports, retrieval
from quillgraph.registry.common import documents, registry, sql_bucket, sql_words, statutes, table
from quillgraph.session import scratch_folder
from quillgraph.sources import sinks, tables
from quillgraph.streaming import conversation, facts
from quillgraph.streaming import failures as failure_stream
from quillgraph.streaming.ingest import run_to_table

QUERIES, SQL, query = registry()


def _stream(spark, sf: str, name: str):
    """The table's files as a stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query(
    "failure_archive_index",
    f"""WITH {reports._F}, d AS (SELECT reason, question_type, st FROM an), k AS (SELECT 'reason' AS kind, reason AS value FROM an UNION ALL SELECT 'question_type', question_type FROM an
      UNION ALL SELECT 'source_type', (['statute_only', 'case_only', 'hybrid'])[CAST(1 + user_id % 3 AS INTEGER)] FROM events)
    SELECT kind, value, count(*) AS n FROM k GROUP BY 1, 2""",
)
def failure_archive_index(spark, sf):
    """Partitioned archive of all failures, counted from the files written."""
    path = scratch_folder(spark)
    sinks.archive_failures(reports.failures(spark, sf).withColumn("timestamp", F.lit("2024-05-01T00:00:00")), path)
    return sinks.archive_index(spark.read.json(path)).select("kind", "value", "n")


@query(
    "stored_chunk_index",
    f"""WITH {retrieval._CHUNKS} SELECT doc_id::VARCHAR AS doc_id, chunk_id, md5(text) AS text,
      md5(array_to_string(list_transform({sql_words('text')}, lambda w: {sql_bucket('w')}), ',')) AS buckets FROM chunks""",
)
def stored_chunk_index(spark, sf):
    """Every chunk of the written index, with its text and hash buckets."""
    path = scratch_folder(spark)
    docs = documents(spark, sf).select("doc_id", F.col("source").alias("title"), "text")
    tables.build_index(docs, path)
    stored = tables.load_index(spark, path)
    buckets = F.array_join(F.transform("buckets", lambda b: b.cast("string")), ",")
    return stored.select("doc_id", "chunk_id", F.md5("text").alias("text"), F.md5(buckets).alias("buckets"))


@query(
    "latency_histogram",
    f"""WITH {reports._R}, b AS (SELECT min(latency) AS lo, max(latency) AS hi FROM results)
    SELECT CAST(least(floor((latency - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin, count(*) AS n FROM results CROSS JOIN b GROUP BY 1""",
)
def latency_histogram(spark, sf):
    return sinks.latency_histogram(reports.results(spark, sf)).select("bin", "n")


@query(
    "status_upsert",
    """SELECT c_custkey AS suggestion_id, CASE WHEN c_custkey % 3 = 0 THEN 'closed' ELSE 'open' END AS status FROM customer""",
)
def status_upsert(spark, sf):
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("suggestion_id"), F.lit("open").alias("status"))
    changes = stored.filter(F.col("suggestion_id") % 3 == 0).withColumn("status", F.lit("Closed"))
    return feedback.upsert_status(stored, changes)


@query("knowledge_base_laws")
def knowledge_base_laws(spark, sf):
    """Law rows with in-text article rewriting (needs a look-behind, which DuckDB's regex lacks)."""
    rows = statutes(spark, sf).select(
        "doc_id", "law_name", "article_no", "chapter", F.lit("2021-01-01").alias("effective_date"), F.col("content").alias("text"),
        F.array("law_name", "article_no", F.lit("盗窃行为")).alias("keywords"),
    )
    out = knowledge_base.clean_laws(rows)
    return out.select("doc_id", "law_name", "article_no", F.md5("text").alias("text"), F.array_join("keywords", ",").alias("keywords"))


@query(
    "knowledge_base_faqs",
    """SELECT conv_id, turn, '出租人' AS topic, (['刑法第二百六十四条', '第五条', '民法典第五百七十七条'])[CAST(1 + turn % 3 AS INTEGER)] AS law FROM conversations WHERE role = 'user'""",
)
def knowledge_base_faqs(spark, sf):
    raw = F.get(
        F.array(F.lit("《中华人民共和国刑法》第二百六十四条"), F.lit("第五条"), F.lit("中华人民共和国民法典第五百七十七条")),
        (F.col("turn") % 3).cast("int"),
    )
    rows = table(spark, sf, "conversations").filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("question"), F.col("text").alias("answer"), F.lit("房东").alias("topic"),
        F.array(raw).alias("related_laws"),
    )
    cleaned = knowledge_base.clean_faqs(rows, "conv_id", "turn")
    return cleaned.select("conv_id", "turn", "topic", F.get("related_laws", 0).alias("law"))


# --- streams ---------------------------------------------------------------------------------
@query("stream_conversation_memory")
def stream_conversation_memory(spark, sf):
    """Stateful memory over the message stream; one row per message."""
    stream = _stream(spark, sf, "conversations")
    path = scratch_folder(spark)
    run_to_table(conversation.conversation_memory(stream), path, f"memory-{uuid.uuid4().hex}").awaitTermination()
    return spark.read.schema(conversation.OUTPUT).parquet(path)


@query(
    "stream_failures_daily",
    "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, md5(strftime(ts, '%Y-%m-%d') || '|' || user_id::VARCHAR || '|' || event_type) AS failure_key FROM events",
)
def stream_failures_daily(spark, sf):
    """One failure per day, question and reason from the event stream."""
    failing = _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("query"), F.col("event_type").alias("failure_reason"),
    )
    path = scratch_folder(spark)
    failure_stream.record_daily(failing, path, f"failures-{uuid.uuid4().hex}").awaitTermination()
    kept = failure_stream.recorded(spark, path, failure_stream.keyed_failures(failing).schema)
    return kept.select("day", "failure_key")


@query(
    "stream_conversation_facts",
    f"""WITH RECURSIVE {dialogue._FACT_FOLD} SELECT conv_id, key, arg_max(value, n) AS value, round(arg_max(confidence, n), 6) AS confidence, arg_max(pair, n) AS turn, count(*) FILTER (WHERE conflict) AS conflicts
    FROM folded GROUP BY conv_id, key""",
)
def stream_conversation_facts(spark, sf):
    """Facts of every conversation whose messages arrive in five micro-batches, turns mixed up."""
    path, source = scratch_folder(spark), scratch_folder(spark)
    said = dialogue._user_facts(spark, sf)
    said.repartition(5, F.xxhash64("conv_id", "turn")).write.parquet(source)
    stream = spark.readStream.schema(said.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run_to_table(facts.conversation_facts(stream), path, f"facts-{uuid.uuid4().hex}", rocksdb=True).awaitTermination()
    last = facts.latest(spark.read.parquet(path)).select("conv_id", F.explode("facts").alias("f"))
    kept = last.select("conv_id", "f.key", "f.kept.*", F.size("f.events").alias("conflicts"))
    return kept.select("conv_id", "key", "value", F.round("confidence", 6).alias("confidence"), "turn", "conflicts")
