"""Failure detection, analysis, suggestions and the action queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import fixed_values as fv
from quillgraph.functions import ids, rules
from quillgraph.functions import text as tx


def failure_reasons() -> Column:
    """Array of threshold failures of one result row, in rule order."""
    checks = []
    for metric, comparison, threshold, reason in fv.FAILURE_RULES:
        value = F.coalesce(F.col(metric), F.lit(0.0))
        failed = value <= threshold if comparison == "<=" else value < threshold
        checks.append(F.when(failed, F.lit(reason)))
    return F.array_compact(F.array(*checks))


def runtime_reasons(candidates: Column, ranked: Column, grounded: Column, grounding: Column, answer: Column, confidence: Column) -> Column:
    """Array of run-time failure reasons of one answer."""
    return F.array_compact(
        F.array(
            F.when((candidates == 0) & (ranked == 0), "retrieval_zero_hit"),
            F.when(~F.coalesce(grounded, F.lit(False)) & (F.coalesce(grounding, F.lit(0.0)) < fv.RUNTIME_GROUNDING), "low_grounding"),
            F.when(tx.contains_any(tx.text_or_empty(answer), fv.INSUFFICIENT_WORDS), "insufficient_evidence"),
            F.when(F.coalesce(confidence, F.lit(0.0)) < fv.RUNTIME_CONFIDENCE, "low_confidence"),
        )
    )


def collect_failures(results: DataFrame) -> DataFrame:
    """Failing rows with id, time and reasons."""
    return (
        results.withColumn("reasons", failure_reasons())
        .filter(F.size("reasons") > 0)
        .withColumn("failure_id", F.expr("uuid()"))
        .withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )


def analyze(failures: DataFrame) -> DataFrame:
    """Topic, primary failure type and explanation of every failure.

    Needs ``original_query``, ``failure_reason``, ``retrieval_strategy``,
    ``candidate_count``, ``ranked_count``, ``vector_hits``, ``graph_nodes`` and
    ``ranked_ids_count``.
    """
    candidates, ranked = F.col("candidate_count"), F.col("ranked_count")
    query, reason = tx.text_or_empty(F.col("original_query")), tx.text_or_empty(F.col("failure_reason"))
    strategy = tx.text_or_empty(F.col("retrieval_strategy"))
    words = fv.FAILURE_REASONS_TEXT

    def found(kind: str, why: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(words[why]).alias("why"))

    verdict = (
        F.when((candidates == 0) & (F.col("vector_hits") == 0) & (F.col("graph_nodes") == 0), found("no_data", "no_data"))
        .when(candidates == 0, found("retrieval_miss", "retrieval_miss"))
        .when(ranked == 0, found("ranking_error", "ranking_empty"))
        .when(F.col("ranked_ids_count") == 0, found("ranking_error", "ranking_ids"))
        .when(reason.contains("rewrite"), found("rewrite_error", "rewrite_error"))
        .when(reason.contains("reasoning"), found("reasoning_error", "reasoning_error"))
        .when(reason.contains("hallucination"), found("answer_hallucination", "answer_hallucination"))
        .when((strategy == "graph") & query.contains("案例"), found("retrieval_strategy_error", "strategy_graph"))
        .when(
            (strategy == "vector") & tx.contains_any(query, ["法条", "哪一条"]),
            found("retrieval_strategy_error", "strategy_vector"),
        )
        .otherwise(found("retrieval_miss", "default"))
    )
    chunking = (candidates > 0) & (ranked > 0) & (F.length(query) > 40) & (F.col("graph_nodes") == 0)
    return (
        failures.withColumn("topic", rules.topic(query))
        .withColumn("__v", verdict)
        .withColumn("primary_failure_type", F.col("__v.kind"))
        .withColumn("analysis_reason", F.col("__v.why"))
        .withColumn("secondary_failure_type", F.when(chunking, "bad_chunking"))
        .drop("__v")
    )


def failure_counts(analyzed: DataFrame) -> DataFrame:
    """Counts by failure type and by topic in one pass (grouping sets)."""
    return analyzed.groupingSets(
        [["primary_failure_type"], ["topic"]], "primary_failure_type", "topic"
    ).agg(F.count(F.lit(1)).alias("n"))


def failure_ratio(analyzed: DataFrame) -> DataFrame:
    counted = analyzed.groupBy("primary_failure_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))


def topic_queries(analyzed: DataFrame, order: str, keep: int = 5) -> DataFrame:
    """(topic, n, first queries): count and the first few queries of each topic."""
    window = Window.partitionBy("topic").orderBy(order)
    firsts = (
        analyzed.select("topic", "original_query", order)
        .withColumn("k", F.row_number().over(window))
        .filter(F.col("k") <= keep)
        .groupBy("topic")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("k", "original_query"))), lambda s: s["original_query"]).alias(
                "supporting_failed_queries"
            )
        )
    )
    counts = analyzed.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return counts.join(firsts, "topic")


def suggestions(analyzed: DataFrame, order: str) -> DataFrame:
    """Data suggestions for the five most frequent topics and one per failing stage."""
    topics = topic_queries(analyzed, order).orderBy(F.desc("n"), F.asc("first_seen")).limit(5).filter("n >= 2")
    data = topics.select(
        F.lit("data_expansion_suggestion").alias("suggestion_type"),
        F.col("topic").alias("target"),
        F.format_string(fv.DATA_EXPANSION_REASON, "topic", "n").alias("reason"),
        F.when(F.col("n") >= 4, "high").otherwise("medium").alias("suggested_priority"),
        F.lit("data_team").alias("suggested_owner"),
        F.lit(fv.DATA_EXPANSION_HINT).alias("execution_hint"),
        "supporting_failed_queries",
    )
    by_type = analyzed.groupBy("primary_failure_type").agg(F.count(F.lit(1)).alias("n"))
    stages = []
    for kinds, kind, target, reason, priority, owner, hint in fv.STAGE_SUGGESTIONS:
        total = by_type.filter(F.col("primary_failure_type").isin(kinds)).agg(F.sum("n").alias("n")).filter("n > 0")
        text = F.format_string(reason, F.col("n")) if "%d" in reason else F.lit(reason)
        stages.append(
            total.select(
                F.lit(kind).alias("suggestion_type"), F.lit(target).alias("target"), text.alias("reason"),
                F.lit(priority).alias("suggested_priority"), F.lit(owner).alias("suggested_owner"),
                F.lit(hint).alias("execution_hint"),
                F.array().cast("array<string>").alias("supporting_failed_queries"),
            )
        )
    out = data
    for stage in stages:
        out = out.unionByName(stage)
    return out.withColumn("status", F.lit("open")).withColumn(
        "suggestion_id", ids.suggestion_id(F.col("suggestion_type"), F.col("target"), F.col("reason"))
    )


def apply_status(rows: DataFrame, statuses: DataFrame, key: str = "suggestion_id") -> DataFrame:
    """Left join the stored status of each suggestion; unknown values mean open."""
    stored = statuses.select(key, F.col("status").alias("stored_status"))
    return rows.join(stored, key, "left").withColumn(
        "status", rules.status(F.coalesce("stored_status", "status"))
    ).drop("stored_status")


def upsert_status(statuses: DataFrame, changes: DataFrame, key: str = "suggestion_id") -> DataFrame:
    """Status table after applying changes (the change wins)."""
    kept = statuses.join(changes.select(key), key, "left_anti")
    return kept.select(key, "status").unionByName(changes.select(key, rules.status(F.col("status")).alias("status")))


def stage_bottlenecks(analyzed: DataFrame, top_n: int = 3) -> DataFrame:
    """Failure types by ratio times severity."""
    rated = failure_ratio(analyzed).withColumn(
        "severity_weight", rules.lookup(F.col("primary_failure_type"), fv.FAILURE_SEVERITY, 0.5)
    )
    return rated.withColumn("pressure", F.round(F.col("ratio") * F.col("severity_weight"), 12)).orderBy(
        F.desc("pressure"), F.desc("n"), "primary_failure_type"
    ).limit(max(1, top_n))


def action_queue(rows: DataFrame, bottlenecks: DataFrame, top_n: int = 10) -> DataFrame:
    """Open suggestions by priority, status and pressure of the stage they address.

    Ties are ordered by the priority name, descending.
    """
    layer_of = [
        (layer, failure) for layer, failures in fv.LAYER_FAILURES.items() for failure in failures
    ]
    failure_layer = rows.sparkSession.createDataFrame(layer_of, "blocking_layer string, primary_failure_type string")
    pressure = (
        bottlenecks.join(F.broadcast(failure_layer), "primary_failure_type")
        .groupBy("blocking_layer")
        .agg(F.sum("pressure").alias("pressure"))
    )
    staged = rows.filter(F.col("status") != "closed").withColumn(
        "blocking_layer", rules.lookup(F.col("suggestion_type"), fv.SUGGESTION_LAYERS, "other")
    )
    # One row per layer: five at most.
    joined = staged.join(F.broadcast(pressure), "blocking_layer", "left")
    load = F.when(F.col("blocking_layer") == "other", 0.1).otherwise(F.coalesce("pressure", F.lit(0.0)))
    w = fv.ACTION_WEIGHTS
    score = (
        rules.lookup(F.col("suggested_priority"), fv.PRIORITY_WEIGHT, 0.7) * w["priority"]
        + rules.lookup(F.col("status"), fv.STATUS_WEIGHT, 1.0) * w["status"]
        + F.least(F.lit(1.0), load) * w["pressure"]
    )
    return (
        joined.withColumn("action_score", F.round(score, 4))
        .drop("pressure")
        .orderBy(F.desc("action_score"), F.desc("suggested_priority"), "suggestion_id")
        .limit(max(1, top_n))
    )


def loop_candidates(analyzed: DataFrame, order: str) -> DataFrame:
    """FAQ, statute and case candidates per topic.

    A topic without any keyword falls back to an FAQ candidate only while no
    earlier topic has produced one, so topics are numbered by first appearance
    and the running flag is a window over the (few) topics.
    """
    flags = analyzed.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(order).alias("first_seen"),
        *[
            F.bool_or(tx.contains_any(tx.text_or_empty(F.col("original_query")), words)).alias(kind)
            for kind, words in fv.CANDIDATE_WORDS.items()
        ],
    )
    own = F.col("faq") | F.col("statute") | F.col("case")
    running = Window.partitionBy().orderBy("first_seen").rowsBetween(Window.unboundedPreceding, -1)
    produced = own | (F.col("n") >= 3)
    earlier = F.coalesce(F.max(produced.cast("int")).over(running), F.lit(0)) == 1
    decided = flags.withColumn("fallback", (F.col("n") >= 3) & ~own & ~earlier)

    def candidate(kind: str, condition: Column, priority: Column) -> Column:
        return F.when(condition, F.struct(F.lit(kind).alias("candidate_type"), priority.alias("suggested_priority")))

    usual = F.when(F.col("n") >= 3, "high").otherwise("medium")
    made = F.array_compact(
        F.array(
            *[candidate(kind, F.col(kind), usual) for kind in fv.CANDIDATE_WORDS],
            candidate("faq", F.col("fallback"), F.lit("medium")),
        )
    )
    first_queries = topic_queries(analyzed, order).select("topic", "supporting_failed_queries")
    return (
        decided.select("topic", F.explode(made).alias("c"))
        .select("topic", "c.candidate_type", "c.suggested_priority")
        .join(first_queries, "topic")
        .withColumn("status", F.lit("open"))
    )


def loop_summary(failures: DataFrame, evaluated: int) -> DataFrame:
    """Failure total and rate; the rate never exceeds one."""
    total = F.count(F.lit(1))
    return failures.agg(
        total.alias("total_failures"),
        F.when(F.greatest(total, F.lit(evaluated)) > 0, total / F.greatest(total, F.lit(evaluated)))
        .otherwise(F.lit(0.0))
        .alias("failure_rate"),
    )
