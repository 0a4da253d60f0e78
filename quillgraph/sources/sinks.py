"""Sinks: JSON lines, failure archive, status table, Markdown summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import ids, rules
from quillgraph.functions import text as tx
from quillgraph.operators import feedback
from quillgraph.sources import files


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def archive_failures(failures: DataFrame, path: str) -> None:
    """Failures partitioned by day and normalised reason; a re-run replaces its own partitions."""
    rows = failures.withColumns(
        {
            "date": F.date_format(F.coalesce(F.to_timestamp("timestamp"), F.current_timestamp()), "yyyy-MM-dd"),
            "reason": rules.failure_reason_key(F.col("failure_reason")),
        }
    )
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "reason")
        .json(path)
    )


def archive_index(archived: DataFrame) -> DataFrame:
    """(date, kind, value, n): counts by reason, question type and source type."""
    named = archived.select(
        "date",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(kind).alias("kind"),
                        F.when(tx.text_or_empty(F.col(kind)) == "", "unknown").otherwise(F.col(kind)).alias("value"),
                    )
                    for kind in ("reason", "question_type", "source_type")
                ]
            )
        ).alias("k"),
    )
    return named.groupBy("date", "k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))


def append_runtime_failures(failures: DataFrame, path: str, day: str) -> DataFrame:
    """Append failures not yet recorded on ``day`` (same question and reason); returns the new rows.

    The key table is partitioned by day, so the anti join reads one partition.
    """
    spark, base = failures.sparkSession, path.rstrip("/")
    keyed = failures.withColumn("failure_key", ids.runtime_failure_key(F.lit(day), F.col("query"), F.col("failure_reason")))
    firsts = keyed.groupBy("failure_key").agg(F.min("failure_id").alias("failure_id"))
    fresh = keyed.join(firsts.select("failure_id"), "failure_id", "left_semi")
    target = f"{base}/day={day}"
    if files._has_files(spark, f"{target}/*.json"):
        known = spark.read.schema(fresh.schema).json(target).select("failure_key")
        fresh = fresh.join(known, "failure_key", "left_anti")
    from quillgraph.session import cut_lineage

    fresh = cut_lineage(fresh)
    fresh.write.mode("append").json(target)
    return fresh


def save_status(statuses: DataFrame, path: str) -> None:
    """Status rows as a parquet table under a new version folder name chosen by the caller."""
    statuses.select("suggestion_id", rules.status(F.col("status")).alias("status")).write.mode("overwrite").parquet(path)


def update_status(spark: SparkSession, source: str, target: str, suggestion_id: str, status: str) -> None:
    """Copy a status table with one changed entry (read and write paths differ)."""
    change = spark.createDataFrame([(suggestion_id, status)], "suggestion_id string, status string")
    save_status(feedback.upsert_status(spark.read.parquet(source), change), target)


def latency_histogram(results: DataFrame, bins: int = 10, column: str = "latency") -> DataFrame:
    """(bin, low, high, n): equal-width histogram of a metric."""
    bounds = results.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if not bounds["n"]:
        return results.sparkSession.createDataFrame([], "bin bigint, low double, high double, n bigint")
    bins = max(1, min(bins, bounds["n"]))
    lo, hi = float(bounds["lo"]), float(bounds["hi"])
    width = (hi - lo) / bins or 1.0
    position = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
    counted = results.filter(F.col(column).isNotNull()).groupBy(position.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"), "n")


def evaluation_markdown(overall: DataFrame, bottleneck: DataFrame, drift: DataFrame, by_type: DataFrame, by_source: DataFrame) -> str:
    """Summary page from already aggregated tables (a few rows each)."""
    o, d = overall.first(), drift.first()
    b = bottleneck.first()
    lines = [
        "# 评测摘要", "", "## Overall",
        f"- 样本数: {o['sample_count']}",
        f"- 检索命中率: {o['retrieval_hit_rate']:.4f}",
        f"- 答案相关性: {o['answer_relevance']:.4f}",
        f"- 引用正确率: {o['citation_correctness']:.4f}",
        f"- Grounding分数: {o['grounding_score']:.4f}",
        "", "## 主要瓶颈", f"- 阶段: {b[0] if b else 'none'}",
        "", "## 检索策略偏差",
        f"- 策略匹配率: {d['match_rate']:.4f}",
        f"- 不匹配数: {d['mismatch_count']} / {d['sample_count']}",
        "", "## 题型短板", *[f"- {r[0]}: {r['summary']}" for r in by_type.collect()],
        "", "## 来源短板", *[f"- {r[0]}: {r['summary']}" for r in by_source.collect()],
    ]
    return "\n".join(lines) + "\n"
