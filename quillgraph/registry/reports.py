"""Queries over evaluation and failure feedback.

Result rows are derived one per document (joined to its label), failure rows
one per event, so every report reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import fixed_values as fv
from quillgraph.functions import ids, rules
from quillgraph.functions import text as tx
from quillgraph.operators import evaluation, feedback
from quillgraph.registry.common import (
    QUESTION_STEMS, pick, registry, sql_contains_any, sql_first_value, sql_list, sql_pick, sql_text, table,
)

QUERIES, SQL, query = registry()

QTYPES = ["statute_lookup", "concept_definition", "case_reasoning"]
STYPES = ["statute_only", "case_only", "hybrid", ""]
STRATEGIES = ["graph", "vector", "hybrid", ""]
ERRORS = ["none", "rewrite_error", "retrieval_error", "ranking_error", "answer_hallucination"]


def results(spark, sf):
    """One evaluation row per document; one without a label counts as good and harmless."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    d, n = F.col("doc_id"), F.col("n_chars")
    joined = docs.select("doc_id", "n_chars", "lang").join(labels, "doc_id", "left")
    return joined.fillna({"quality": 1, "toxic": 0}).select(
        d.alias("id"),
        pick(QTYPES, d).alias("question_type"),
        pick(STYPES, d).alias("source_type"),
        (F.col("toxic") == 1).alias("requires_multiturn"),
        F.col("quality").cast("double").alias("evidence_path_hit_rate"),
        ((n % 11) / 10.0).alias("answer_keyword_match_rate"),
        ((n % 7) / 7.0).alias("citation_correctness"),
        ((n % 5) / 5.0).alias("citation_coverage"),
        ((n % 13) / 13.0).alias("grounding_score"),
        (n / 1000.0).alias("latency"),
        pick(STRATEGIES, d).alias("expected_retrieval_strategy"),
        pick(STRATEGIES[:3], n).alias("actual_retrieval_strategy"),
        pick(ERRORS, n).alias("primary_error_type"),
        (F.col("quality") == 0).alias("reflection_triggered"),
    )


_R = f"""results AS (SELECT doc_id AS id, {sql_pick(QTYPES, 'doc_id')} AS question_type, {sql_pick(STYPES, 'doc_id')} AS source_type, coalesce(toxic, 0) = 1 AS requires_multiturn,
  coalesce(quality, 1)::DOUBLE AS evidence_path_hit_rate, (n_chars % 11) / 10.0::DOUBLE AS answer_keyword_match_rate, (n_chars % 7) / 7.0::DOUBLE AS citation_correctness, (n_chars % 5) / 5.0::DOUBLE AS citation_coverage,
  (n_chars % 13) / 13.0::DOUBLE AS grounding_score, n_chars / 1000.0::DOUBLE AS latency, {sql_pick(STRATEGIES, 'doc_id')} AS expected, {sql_pick(STRATEGIES[:3], 'n_chars')} AS actual,
  {sql_pick(ERRORS, 'n_chars')} AS primary_error_type, coalesce(quality, 1) = 0 AS reflection_triggered FROM documents LEFT JOIN labels USING (doc_id))"""
_AVG = """count(*) AS sample_count, round(coalesce(avg(evidence_path_hit_rate), 0), 6) AS retrieval_hit_rate, round(coalesce(avg(answer_keyword_match_rate), 0), 6) AS answer_relevance,
 round(coalesce(avg(citation_correctness), 0), 6) AS citation_correctness, round(coalesce(avg(citation_coverage), 0), 6) AS citation_coverage, round(coalesce(avg(grounding_score), 0), 6) AS grounding_score, round(coalesce(avg(latency), 0), 6) AS average_latency"""


def _rounded(df):
    return df.select(*[F.round(n, 6).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


@query("eval_overall", f"WITH {_R} SELECT {_AVG} FROM results")
def eval_overall(spark, sf):
    return _rounded(evaluation.overall(results(spark, sf)))


@query(
    "eval_by_question_type",
    f"WITH {_R}, d AS (SELECT unnest({sql_list(fv.QUESTION_TYPES)}) AS question_type) SELECT d.question_type, {_AVG.replace('count(*)', 'count(id)')} FROM d LEFT JOIN results USING (question_type) GROUP BY 1",
)
def eval_by_question_type(spark, sf):
    return _rounded(evaluation.by_question_type(results(spark, sf)))


@query(
    "eval_by_source_type",
    f"WITH {_R}, d AS (SELECT unnest({sql_list(fv.SOURCE_TYPES)}) AS source_type) SELECT d.source_type, {_AVG.replace('count(*)', 'count(id)')} FROM d LEFT JOIN results USING (source_type) GROUP BY 1",
)
def eval_by_source_type(spark, sf):
    return _rounded(evaluation.by_source_type(results(spark, sf)))


@query("eval_multiturn", f"WITH {_R} SELECT {_AVG} FROM results WHERE requires_multiturn")
def eval_multiturn(spark, sf):
    return _rounded(evaluation.multiturn(results(spark, sf)))


@query("eval_trigger_rate", f"WITH {_R} SELECT round(avg(reflection_triggered::INT), 8) AS reflection_trigger_rate FROM results")
def eval_trigger_rate(spark, sf):
    out = evaluation.trigger_rate(results(spark, sf))
    return out.select(F.round("reflection_trigger_rate", 8).alias("reflection_trigger_rate"))


@query(
    "error_distribution",
    f"WITH {_R} SELECT primary_error_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS ratio FROM results WHERE primary_error_type <> 'none' GROUP BY 1",
)
def error_distribution(spark, sf):
    return evaluation.error_distribution(results(spark, sf)).withColumn("ratio", F.round("ratio", 8))


@query(
    "error_bottleneck",
    f"WITH {_R} SELECT primary_error_type, count(*) AS n, min(id) AS first_seen FROM results WHERE primary_error_type <> 'none' GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 1",
)
def error_bottleneck(spark, sf):
    return evaluation.most_common(results(spark, sf).filter("primary_error_type <> 'none'"), "primary_error_type", "id")


def _matrix_sql(key: str) -> str:
    cells = ", ".join(f"count(*) FILTER (WHERE primary_error_type = '{e}') AS {e}" for e in ERRORS[1:])
    return f"WITH {_R} SELECT CASE WHEN {key} = '' THEN 'unknown' ELSE {key} END AS {key}, {cells} FROM results WHERE primary_error_type <> 'none' GROUP BY 1"


@query("error_matrix_question_type", _matrix_sql("question_type"))
def error_matrix_question_type(spark, sf):
    return evaluation.error_matrix(results(spark, sf), "question_type", ERRORS[1:])


@query("error_matrix_source_type", _matrix_sql("source_type"))
def error_matrix_source_type(spark, sf):
    return evaluation.error_matrix(results(spark, sf), "source_type", ERRORS[1:])


_SCORE = "round(0.35 * answer_keyword_match_rate + 0.25 * evidence_path_hit_rate + 0.2 * citation_correctness + 0.2 * grounding_score, 12)"


@query("worst_samples", f"WITH {_R} SELECT id, round({_SCORE}, 8) AS sample_score FROM results ORDER BY {_SCORE}, id LIMIT 10")
def worst_samples(spark, sf):
    return evaluation.worst_samples(results(spark, sf), "id").select("id", F.round("sample_score", 8).alias("sample_score"))


@query(
    "worst_by_bucket",
    f"WITH {_R}, r AS (SELECT id, CASE WHEN source_type = '' THEN 'unknown' ELSE source_type END AS source_type, {_SCORE} AS s FROM results), w AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY s, id) AS n FROM r) SELECT id, source_type, n FROM w WHERE n <= 3",
)
def worst_by_bucket(spark, sf):
    return evaluation.worst_by_bucket(results(spark, sf), "source_type", "id").select("id", "source_type", "n")


@query(
    "weakest_metric",
    f"""WITH {_R}, m AS (SELECT question_type, {_AVG} FROM results GROUP BY 1), l AS (SELECT *, least(retrieval_hit_rate, answer_relevance, citation_correctness, grounding_score) AS v FROM m)
    SELECT question_type, CASE v WHEN retrieval_hit_rate THEN 'retrieval' WHEN answer_relevance THEN 'answer_relevance' WHEN citation_correctness THEN 'citation' ELSE 'grounding' END AS weakest, round(v, 4) AS weakest_value FROM l
    UNION ALL SELECT 'multiturn_followup', NULL, NULL""",
)
def weakest_metric(spark, sf):
    metrics = evaluation.by_question_type(results(spark, sf))
    return evaluation.weakest_metric(metrics).select("question_type", "weakest", "weakest_value")


@query(
    "strategy_drift",
    f"WITH {_R} SELECT count(*) AS sample_count, count(*) FILTER (WHERE expected = actual) AS match_count, count(*) FILTER (WHERE expected <> actual) AS mismatch_count, round(avg((expected = actual)::INT), 8) AS match_rate FROM results WHERE expected <> ''",
)
def strategy_drift(spark, sf):
    summary, _ = evaluation.strategy_drift(results(spark, sf))
    return summary.withColumn("match_rate", F.round("match_rate", 8))


@query("strategy_mismatches", f"WITH {_R} SELECT expected || '->' || actual AS pattern, count(*) AS n FROM results WHERE expected <> '' AND expected <> actual GROUP BY 1")
def strategy_mismatches(spark, sf):
    return evaluation.strategy_drift(results(spark, sf))[1]


# --- per-question metrics over text ----------------------------------------------------------


@query(
    "metric_keyword_match",
    rf"""WITH l AS (SELECT doc_id, lower(text) AS t, string_split(lang || ',' || source || ',' || substr(text, 1, 5) || ',zzz', ',') AS k FROM documents)
    SELECT doc_id, round(len(list_filter(k, lambda x: contains(t, trim(lower(x))))) / len(k), 8) AS rate FROM l""",
)
def metric_keyword_match(spark, sf):
    words = F.split(F.concat_ws(",", "lang", "source", F.substring("text", 1, 5), F.lit("zzz")), ",")
    return table(spark, sf, "documents").select(
        "doc_id", F.round(evaluation.keyword_match_rate(words, F.col("text")), 8).alias("rate")
    )


@query(
    "metric_citation_correctness",
    """WITH c AS (SELECT conv_id, list(role || (turn % 3)::VARCHAR) AS cited FROM conversations GROUP BY 1), e AS (SELECT conv_id, list(DISTINCT role || (turn % 2)::VARCHAR) AS ids FROM conversations GROUP BY 1)
    SELECT conv_id, round(len(list_filter(cited, lambda x: list_contains(ids, x))) / len(cited), 8) AS rate FROM c JOIN e USING (conv_id)""",
)
def metric_citation_correctness(spark, sf):
    """Cited ids of a conversation against its evidence ids, through the operator."""
    cited = F.concat("role", (F.col("turn") % 3).cast("string"))
    known = F.concat("role", (F.col("turn") % 2).cast("string"))
    lists = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.collect_list(cited).alias("cited"), F.collect_set(known).alias("ids")
    )
    return lists.select("conv_id", F.round(evaluation.citation_correctness(F.col("cited"), F.col("ids")), 8).alias("rate"))


_BENCH = ["法条定位类", "案例支撑类", "FAQ", "其他", "multiturn"]


@query(
    "benchmark_normalize",
    f"""WITH b AS (SELECT conv_id * 1000 + turn AS id, {sql_pick(_BENCH, 'conv_id + turn')} AS c, {sql_pick(QUESTION_STEMS, 'conv_id + 3 * turn')} AS q, {sql_pick(['', 'hybrid', 'case_only'], 'turn')} AS gs, {sql_pick(['', 'graph', 'vector', 'hybrid'], 'conv_id')} AS st FROM conversations WHERE role = 'user'),
    t AS (SELECT *, CASE WHEN {sql_contains_any('lower(c)', ['法条定位'])} THEN 'statute_lookup' WHEN contains(c, '案例支撑') THEN 'case_reasoning' WHEN contains(c, 'multiturn') THEN 'multiturn_followup' WHEN contains(lower(c), 'faq') THEN 'concept_definition'
        WHEN {sql_contains_any('q', ['一定要', '是不是'])} THEN 'concept_definition' WHEN contains(c, '案例') OR {sql_contains_any('q', ['法院', '案件'])} THEN 'case_reasoning' WHEN contains(c, '法条') OR {sql_contains_any('q', ['哪一条', '依据哪条'])} THEN 'statute_lookup' ELSE 'concept_definition' END AS question_type,
      CASE WHEN contains(c, '法条定位') THEN 'statute_only' WHEN contains(c, '案例支撑') THEN 'case_only' WHEN contains(lower(c), 'faq') THEN 'statute_only' WHEN st = 'graph' THEN 'statute_only' WHEN st = 'vector' THEN 'case_only' WHEN st = 'hybrid' THEN 'hybrid'
        WHEN {sql_contains_any('q', ['法院', '案件'])} THEN CASE WHEN contains(q, '依据') THEN 'hybrid' ELSE 'case_only' END WHEN {sql_contains_any('q', ['哪一条', '依据哪条'])} THEN 'statute_only' ELSE 'hybrid' END AS inf FROM b),
    s AS (SELECT *, CASE WHEN gs IN ('', 'hybrid') AND (CASE WHEN gs = '' THEN inf ELSE gs END) = 'hybrid' AND inf IN ('statute_only', 'case_only') AND st IN ('', 'graph', 'vector') THEN inf WHEN gs = '' THEN inf ELSE gs END AS source_type FROM t)
    SELECT id, question_type, source_type, question_type = 'multiturn_followup' AS requires_multiturn,
      CASE WHEN st <> '' THEN st WHEN question_type = 'multiturn_followup' THEN 'hybrid' WHEN source_type = 'statute_only' THEN 'graph' WHEN source_type = 'case_only' THEN 'vector' ELSE 'hybrid' END AS expected_retrieval_strategy FROM s""",
)
def benchmark_normalize(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf, "conversations").filter("role = 'user'").select(
        (c * 1000 + t).alias("id"), pick(_BENCH, c + t).alias("category"), pick(QUESTION_STEMS, c + 3 * t).alias("query"),
        F.lit("").alias("question_type"), pick(["", "hybrid", "case_only"], t).alias("source_type"),
        F.lit(None).cast("boolean").alias("requires_multiturn"), pick(["", "graph", "vector", "hybrid"], c).alias("expected_retrieval_strategy"),
    )
    return evaluation.normalize_benchmark(rows).select(
        "id", "question_type", "source_type", "requires_multiturn", "expected_retrieval_strategy"
    )


@query(
    "stratified_sample",
    f"""WITH {_R}, p AS (SELECT question_type, min_by(id, md5('7:' || id::VARCHAR)) AS id FROM results GROUP BY 1), o AS (SELECT r.id, CASE WHEN p.id IS NULL THEN 1 ELSE 0 END AS pass,
      CASE WHEN p.id IS NULL THEN 0 ELSE list_position(['statute_lookup', 'case_reasoning', 'multiturn_followup', 'concept_definition'], r.question_type) END AS f FROM results r LEFT JOIN p ON r.id = p.id) SELECT id FROM o ORDER BY pass, f, id LIMIT 12""",
)
def stratified_sample(spark, sf):
    return evaluation.stratified_sample(results(spark, sf), 12, 7).select("id")


# --- failures -----------------------------------------------------------------------------------
_SIMPLE_STEMS = [s for s in QUESTION_STEMS]
_REASONS = ["low_grounding", "rewrite_error", "reasoning_error", "answer_hallucination", "retrieval_zero_hit"]


def failures(spark, sf):
    """One failure record per event."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        e.alias("ord"), pick(_SIMPLE_STEMS, e).alias("original_query"), pick(_REASONS, u).alias("failure_reason"),
        pick(STRATEGIES[:3], u + e).alias("retrieval_strategy"), pick(QTYPES, e).alias("question_type"), pick(STYPES[:3], u).alias("source_type"),
        (e % 5).cast("int").alias("candidate_count"), (u % 4).cast("int").alias("ranked_count"), (u % 3).cast("int").alias("vector_hits"),
        (e % 2).cast("int").alias("graph_nodes"), (e % 7).cast("int").alias("ranked_ids_count"),
    )


_F = f"""f AS (SELECT event_id AS ord, {sql_pick(_SIMPLE_STEMS, 'event_id')} AS q, {sql_pick(_REASONS, 'user_id')} AS reason, {sql_pick(STRATEGIES[:3], 'user_id + event_id')} AS st, {sql_pick(QTYPES, 'event_id')} AS question_type,
  event_id % 5 AS cc, user_id % 4 AS rc, user_id % 3 AS vh, event_id % 2 AS gn, event_id % 7 AS ri FROM events),
an AS (SELECT *, {sql_first_value('q', fv.TOPIC_HINTS.items(), sql_text(fv.TOPIC_OTHER))} AS topic,
  CASE WHEN cc = 0 AND vh = 0 AND gn = 0 THEN 'no_data' WHEN cc = 0 THEN 'retrieval_miss' WHEN rc = 0 OR ri = 0 THEN 'ranking_error' WHEN contains(reason, 'rewrite') THEN 'rewrite_error' WHEN contains(reason, 'reasoning') THEN 'reasoning_error'
    WHEN contains(reason, 'hallucination') THEN 'answer_hallucination' WHEN st = 'graph' AND contains(q, '案例') THEN 'retrieval_strategy_error' WHEN st = 'vector' AND (contains(q, '法条') OR contains(q, '哪一条')) THEN 'retrieval_strategy_error' ELSE 'retrieval_miss' END AS pt,
  CASE WHEN cc > 0 AND rc > 0 AND length(q) > 40 AND gn = 0 THEN 'bad_chunking' END AS sec FROM f)"""


@query("failure_analysis", f"WITH {_F} SELECT ord, topic, pt AS primary_failure_type, coalesce(sec, '') AS secondary FROM an")
def failure_analysis(spark, sf):
    out = feedback.analyze(failures(spark, sf))
    return out.select("ord", "topic", "primary_failure_type", F.coalesce("secondary_failure_type", F.lit("")).alias("secondary"))


@query(
    "failure_counts",
    f"WITH {_F} SELECT coalesce(pt, '-') AS primary_failure_type, coalesce(topic, '-') AS topic, count(*) AS n FROM an GROUP BY GROUPING SETS ((pt), (topic))",
)
def failure_counts(spark, sf):
    return feedback.failure_counts(feedback.analyze(failures(spark, sf))).na.fill("-")


@query("failure_thresholds", f"""WITH {_R} SELECT id, array_to_string(list_filter([CASE WHEN evidence_path_hit_rate <= 0 THEN 'retrieval_zero_hit' END, CASE WHEN answer_keyword_match_rate < 0.2 THEN 'low_answer_relevance' END,
  CASE WHEN citation_correctness < 0.2 THEN 'citation_incorrect' END, CASE WHEN grounding_score < 0.1 THEN 'low_grounding' END], lambda x: x IS NOT NULL), ',') AS reasons FROM results""")
def failure_thresholds(spark, sf):
    return results(spark, sf).select("id", F.array_join(feedback.failure_reasons(), ",").alias("reasons"))


@query(
    "runtime_failures",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 5 = 0 AND user_id % 4 = 0 THEN 'retrieval_zero_hit' END, CASE WHEN event_type <> 'click' AND value / 100 < 0.1 THEN 'low_grounding' END,
    CASE WHEN event_type = 'error' THEN 'insufficient_evidence' END, CASE WHEN value / 50 < 0.35 THEN 'low_confidence' END], lambda x: x IS NOT NULL), ',') AS reasons FROM events""",
)
def runtime_failures(spark, sf):
    v = F.col("value")
    reasons = feedback.runtime_reasons(
        F.col("event_id") % 5, F.col("user_id") % 4, F.col("event_type") == "click", v / 100,
        F.when(F.col("event_type") == "error", "证据不足").otherwise("ok"), v / 50,
    )
    return table(spark, sf, "events").select("event_id", F.array_join(reasons, ",").alias("reasons"))


@query(
    "topic_failures",
    f"""WITH {_F}, r AS (SELECT topic, q, ord, row_number() OVER (PARTITION BY topic ORDER BY ord) AS k FROM an), n AS (SELECT topic, count(*) AS n FROM an GROUP BY 1 HAVING count(*) >= 2)
    SELECT topic, n, string_agg(q, '|' ORDER BY k) AS queries FROM n JOIN r USING (topic) WHERE k <= 5 GROUP BY 1, 2""",
)
def topic_failures(spark, sf):
    out = feedback.topic_queries(feedback.analyze(failures(spark, sf)), "ord").filter("n >= 2")
    return out.select("topic", "n", F.array_join("supporting_failed_queries", "|").alias("queries"))


_SUGGEST = f"""{_F}, tp AS (SELECT topic, count(*) AS n, min(ord) AS o FROM an GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 5), bt AS (SELECT pt, count(*) AS n FROM an GROUP BY 1),
sg AS (SELECT 'data_expansion_suggestion' AS suggestion_type, topic AS target, '失败样本中 ' || topic || ' 出现 ' || n::VARCHAR || ' 次，知识覆盖可能不足。' AS reason, CASE WHEN n >= 4 THEN 'high' ELSE 'medium' END AS suggested_priority FROM tp WHERE n >= 2
  UNION ALL SELECT 'cleaning_suggestion', 'chunking_rules', {sql_text(fv.STAGE_SUGGESTIONS[0][3])}, 'high' FROM bt WHERE pt = 'bad_chunking'
  UNION ALL SELECT 'rewrite_rule_suggestion', 'ellipsis_and_followup_patterns', 'rewrite_error 出现 ' || n::VARCHAR || ' 次，建议扩展追问改写规则。', 'high' FROM bt WHERE pt = 'rewrite_error'
  UNION ALL SELECT 'retrieval_strategy_suggestion', 'router_strategy_rules', 'retrieval_strategy_error 出现 ' || n::VARCHAR || ' 次，建议调整 graph/vector/hybrid 路由规则。', 'medium' FROM bt WHERE pt = 'retrieval_strategy_error'
  UNION ALL SELECT 'ranking_suggestion', 'ranking_weights_and_topk', {sql_text(fv.STAGE_SUGGESTIONS[3][3])}, 'medium' FROM (SELECT sum(n) AS n FROM bt WHERE pt IN ('ranking_error', 'retrieval_miss') HAVING sum(n) > 0)),
si AS (SELECT *, substr(md5(suggestion_type || '|' || target || '|' || reason), 1, 12) AS suggestion_id FROM sg)"""


@query("suggestions", f"WITH {_SUGGEST} SELECT suggestion_id, suggestion_type, target, reason, suggested_priority FROM si")
def suggestions(spark, sf):
    out = feedback.suggestions(feedback.analyze(failures(spark, sf)), "ord")
    return out.select("suggestion_id", "suggestion_type", "target", "reason", "suggested_priority")


_BN = f"""bn AS (SELECT pt, n, n / sum(n) OVER () AS ratio, CASE pt {' '.join(f"WHEN '{k}' THEN {v}" for k, v in fv.FAILURE_SEVERITY.items())} ELSE 0.5 END AS w FROM bt),
b5 AS (SELECT *, round(ratio * w, 12) AS pressure FROM bn ORDER BY round(ratio * w, 12) DESC, n DESC, pt LIMIT 5)"""


@query("stage_bottlenecks", f"WITH {_SUGGEST}, {_BN} SELECT pt AS primary_failure_type, n, round(pressure, 8) AS pressure FROM b5 ORDER BY b5.pressure DESC, n DESC, pt LIMIT 3")
def stage_bottlenecks(spark, sf):
    out = feedback.stage_bottlenecks(feedback.analyze(failures(spark, sf)))
    return out.select("primary_failure_type", "n", F.round("pressure", 8).alias("pressure"))


@query(
    "action_queue",
    f"""WITH {_SUGGEST}, {_BN}, la AS (SELECT CASE pt WHEN 'no_data' THEN 'data' WHEN 'bad_chunking' THEN 'chunking' WHEN 'rewrite_error' THEN 'rewrite' WHEN 'retrieval_strategy_error' THEN 'retrieval' WHEN 'retrieval_miss' THEN 'retrieval' WHEN 'ranking_error' THEN 'ranking' END AS layer, sum(pressure) AS p FROM b5 GROUP BY 1),
    s AS (SELECT suggestion_id, suggested_priority, CASE suggestion_type WHEN 'data_expansion_suggestion' THEN 'data' WHEN 'cleaning_suggestion' THEN 'chunking' WHEN 'rewrite_rule_suggestion' THEN 'rewrite' WHEN 'retrieval_strategy_suggestion' THEN 'retrieval' ELSE 'ranking' END AS blocking_layer FROM si)
    SELECT suggestion_id, blocking_layer, round(CASE suggested_priority WHEN 'high' THEN 1.0 ELSE 0.7 END * 0.5 + 0.2 + least(1.0, coalesce(p, 0)) * 0.3, 4)::DOUBLE AS action_score FROM s LEFT JOIN la ON la.layer = s.blocking_layer ORDER BY 3 DESC LIMIT 10""",
)
def action_queue(spark, sf):
    analyzed = feedback.analyze(failures(spark, sf))
    out = feedback.action_queue(feedback.suggestions(analyzed, "ord"), feedback.stage_bottlenecks(analyzed, 5))
    return out.select("suggestion_id", "blocking_layer", "action_score")


@query(
    "action_status",
    """WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'In_Progress ' WHEN c_custkey % 3 = 0 THEN 'closed' ELSE 'odd' END AS status FROM customer)
    SELECT o_orderkey, CASE WHEN lower(trim(coalesce(status, 'open'))) IN ('open', 'in_progress', 'closed') THEN lower(trim(coalesce(status, 'open'))) ELSE 'open' END AS status FROM orders LEFT JOIN s ON o_custkey = c_custkey AND c_custkey % 5 <> 0""",
)
def action_status(spark, sf):
    k = F.col("c_custkey")
    stored = table(spark, sf, "customer").filter(k % 5 != 0).select(
        k.alias("suggestion_id"), F.when(k % 2 == 0, "In_Progress ").when(k % 3 == 0, "closed").otherwise("odd").alias("status")
    )
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("suggestion_id"), F.lit("open").alias("status"))
    return feedback.apply_status(rows, stored).select("o_orderkey", "status")


@query(
    "loop_candidates",
    f"""WITH {_F}, g AS (SELECT topic, count(*) AS n, min(ord) AS o, bool_or({sql_contains_any('q', fv.CANDIDATE_WORDS['faq'])}) AS faq, bool_or({sql_contains_any('q', fv.CANDIDATE_WORDS['statute'])}) AS statute, bool_or({sql_contains_any('q', fv.CANDIDATE_WORDS['case'])}) AS cas FROM an GROUP BY 1),
    h AS (SELECT *, faq OR statute OR cas AS own, coalesce(max((faq OR statute OR cas OR n >= 3)::INT) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM g)
    SELECT topic, 'faq' AS candidate_type, CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END AS suggested_priority FROM h WHERE faq UNION ALL SELECT topic, 'statute', CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END FROM h WHERE statute
    UNION ALL SELECT topic, 'case', CASE WHEN n >= 3 THEN 'high' ELSE 'medium' END FROM h WHERE cas UNION ALL SELECT topic, 'faq', 'medium' FROM h WHERE n >= 3 AND NOT own AND earlier = 0""",
)
def loop_candidates(spark, sf):
    out = feedback.loop_candidates(feedback.analyze(failures(spark, sf)), "ord")
    return out.select("topic", "candidate_type", "suggested_priority")


@query("loop_summary", "SELECT count(*) AS total_failures, round(count(*) / greatest(count(*), 20000), 8) AS failure_rate FROM events")
def loop_summary(spark, sf):
    return feedback.loop_summary(failures(spark, sf), 20000).withColumn("failure_rate", F.round("failure_rate", 8))


@query(
    "primary_errors",
    """WITH e AS (SELECT event_id, event_type = 'click' AS mt, user_id % 2 = 0 AS tr, event_id % 3 = 0 AS nr, event_id % 5 AS cc, user_id % 4 AS rc, value / 100 AS g, (event_id % 10) / 10.0 AS k, (user_id % 10) / 10.0 AS c, event_id % 4 AS li, user_id % 6 AS un FROM events)
    SELECT event_id, CASE WHEN mt AND NOT tr AND nr THEN 'rewrite_error' WHEN (cc = 0 AND k <= 0) THEN 'retrieval_error' WHEN cc > 0 AND rc = 0 THEN 'ranking_error' WHEN cc > 0 AND rc > 0 AND c <= 0 THEN 'ranking_error'
      WHEN un > 0 AND g < 0.1 THEN 'reasoning_error' WHEN g < 0.12 OR (c < 0.2 AND k < 0.3) THEN 'answer_hallucination' WHEN k < 0.2 THEN 'reasoning_error' ELSE 'none' END AS error FROM e""",
)
def primary_errors(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    none = F.array().cast("array<string>")
    row = {
        "requires_multiturn": F.col("event_type") == "click", "rewrite_triggered": u % 2 == 0, "need_rewrite": e % 3 == 0,
        "expected_entities": none, "rewritten_query": F.lit(""), "expected_ids": none, "candidate_ids": none, "ranked_ids": none,
        "candidate_count": e % 5, "ranked_count": u % 4, "evidence_path_hit_rate": (e % 10) / 10.0, "linked_count": e % 4,
        "citation_correctness": (u % 10) / 10.0, "unsupported_count": u % 6, "grounding_score": F.col("value") / 100,
        "grounded": F.col("value") / 100 >= 0.12, "answer_keyword_match_rate": (e % 10) / 10.0,
    }
    return table(spark, sf, "events").select("event_id", evaluation.primary_error(row).alias("error"))
