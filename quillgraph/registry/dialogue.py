"""Queries over question understanding and conversation memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import fixed_values as fv
from quillgraph.functions import rules
from quillgraph.functions import text as tx
from quillgraph.operators import memory, questions as qn
from quillgraph.operators.skew import previous_value
from quillgraph.registry.common import (
    QUESTIONS_SQL, questions, registry, sql_contains_any, sql_first_value, sql_list, sql_strip, sql_text,
    sql_tokens_estimate, table,
)
from quillgraph.session import compute_once

QUERIES, SQL, query = registry()


def _type_sql(q: str) -> str:
    whens = " ".join(
        f"WHEN {sql_contains_any(q, any_of)}{f' AND NOT {sql_contains_any(q, none_of)}' if none_of else ''} THEN {sql_text(kind)}"
        for any_of, none_of, kind in fv.QUESTION_TYPE_RULES
    )
    return f"CASE {whens} ELSE 'unknown' END"


def _strategy_sql(q: str, kind: str) -> str:
    whens = []
    for any_of, also, none_of, wanted, strategy, _ in fv.STRATEGY_RULES:
        if wanted:
            condition = f"{kind} = {sql_text(wanted)}"
        else:
            english = [w for w in any_of if w.isascii()]
            condition = sql_contains_any(q, [w for w in any_of if not w.isascii()])
            if english:
                condition = f"({condition} OR {sql_contains_any(f'lower({q})', english)})"
        if also:
            condition += f" AND {sql_contains_any(q, also)}"
        if none_of:
            condition += f" AND NOT {sql_contains_any(q, none_of)}"
        whens.append(f"WHEN {condition} THEN {sql_text(strategy)}")
    return f"CASE {' '.join(whens)} ELSE {sql_text(fv.STRATEGY_DEFAULT[0])} END"


_Q = f"{QUESTIONS_SQL}, q AS (SELECT qid, conv_id, turn, {sql_strip('query')} AS q, query FROM questions), qt AS (SELECT *, {_type_sql('q')} AS question_type FROM q)"


@query(
    "strategy_route",
    f"""WITH {_Q}, s AS (SELECT qid, question_type, {_strategy_sql('q', 'question_type')} AS retrieval_strategy FROM qt)
    SELECT *, CASE retrieval_strategy WHEN 'vector' THEN 'vector_retrieval' WHEN 'hybrid' THEN 'hybrid_retrieval' WHEN 'direct_answer' THEN 'direct_answer' ELSE 'graph_reasoning' END AS route,
    CASE retrieval_strategy WHEN 'vector' THEN 2 WHEN 'hybrid' THEN 3 WHEN 'direct_answer' THEN 0 ELSE 2 END::BIGINT AS n_tools FROM s""",
)
def strategy_route(spark, sf):
    return qn.routed(questions(spark, sf)).select(
        "qid", "question_type", "retrieval_strategy", "route", F.size("preferred_tools").alias("n_tools")
    )


@query(
    "planned_actions",
    f"""WITH {_Q}, s AS (SELECT qid, {_strategy_sql('q', 'question_type')} AS st FROM qt)
    SELECT unnest(CASE st WHEN 'vector' THEN ['vector_search', 'legal_article_lookup'] WHEN 'hybrid' THEN ['case_lookup', 'graph_search', 'vector_search']
      WHEN 'direct_answer' THEN [] ELSE ['graph_search', 'legal_article_lookup'] END) AS action, qid FROM s""",
)
def planned_actions(spark, sf):
    routed = qn.routed(questions(spark, sf))
    return routed.select("qid", F.explode(qn.plan_actions(F.col("query"), F.col("preferred_tools"))).alias("a")).select("qid", "a.action")


_EXTRA = " , ".join(f"CASE WHEN contains(q, {sql_text(k)}) THEN {sql_list(v)} ELSE [] END" for k, v in fv.QUERY_EXPANSION.items())
_EX = f"flatten([{_EXTRA}, CASE WHEN length(q) <= 10 AND NOT regexp_matches(q, '{fv.SHORT_QUERY_EXEMPT}') THEN {sql_list(fv.SHORT_QUERY_HINTS)} ELSE [] END])"


@query(
    "query_expand",
    f"""WITH {_Q}, e AS (SELECT qid, q, {_EX} AS x FROM q), d AS (SELECT qid, q, list_filter(x, lambda v, i: list_position(x, v) = i) AS x FROM e)
    SELECT qid, CASE WHEN len(x) = 0 OR q = '' THEN q ELSE q || ' ' || array_to_string(x, ' ') END AS expanded FROM d""",
)
def query_expand(spark, sf):
    return questions(spark, sf).select("qid", qn.expand_query(F.col("query")).alias("expanded"))


@query(
    "query_decompose",
    rf"""WITH {_Q}, p AS (SELECT qid, q, list_filter(list_transform(string_split_regex(query, '[，。；;]\s*|以及|并且|同时|和'), lambda s: {sql_strip('s')}), lambda s: s <> '') AS p FROM q)
    SELECT qid, array_to_string(CASE WHEN len(p) = 0 OR (len(p) = 1 AND NOT contains(p[1], '什么') AND NOT contains(p[1], '如何')) THEN [q] ELSE p[1:3] END, '|') AS parts FROM p""",
)
def query_decompose(spark, sf):
    return questions(spark, sf).select("qid", F.array_join(qn.decompose(F.col("query")), "|").alias("parts"))


_SIG = f"""sig AS (SELECT q.*, CAST(floor(turn / 2) AS BIGINT) AS n, list_filter([
  CASE WHEN length(q) <= 10 THEN 'short_query' END, CASE WHEN {sql_contains_any('q', fv.PRONOUN_WORDS)} THEN 'pronoun_or_reference' END,
  CASE WHEN {' OR '.join(f"starts_with(q, {sql_text(w)})" for w in fv.FOLLOWUP_STARTS)} THEN 'followup_pattern' END,
  CASE WHEN NOT {sql_contains_any('q', fv.LEGAL_ENTITY_HINTS)} THEN 'missing_legal_entity' END,
  CASE WHEN turn >= 2 AND {sql_contains_any('q', fv.DEPENDENT_WORDS)} THEN 'depends_on_previous_turn' END], lambda x: x IS NOT NULL) AS s FROM q),
gate AS (SELECT *, (len(s) > 0 AND n > 0) OR {sql_contains_any('q', fv.STRONG_FOLLOWUP_WORDS)} AS needed FROM sig)"""


@query("rewrite_gate", f"WITH {_Q}, {_SIG} SELECT qid, array_to_string(s, ',') AS signals, needed FROM gate")
def rewrite_gate(spark, sf):
    turns = F.floor(F.col("turn") / 2)
    signals = qn.rewrite_signals(F.col("query"), turns)
    return questions(spark, sf).select(
        "qid", F.array_join(signals, ",").alias("signals"), qn.needs_rewrite(F.col("query"), signals, turns, F.lit(False)).alias("needed")
    )


_ENT = f"regexp_extract_all(coalesce(anchor, '') || ' ', {sql_text(fv.REWRITE_ENTITY_PATTERN)})"
_TRIM = "regexp_replace(regexp_replace(q, '^(那如果|那么|如果|那这个|这个|这种情况|这种|那呢|然后)+', ''), '^[，。！？? ]+|[，。！？? ]+$', '', 'g')"


@query(
    "query_rewrite",
    f"""WITH {_Q}, {_SIG}, a AS (SELECT *, lag(q) OVER (PARTITION BY conv_id ORDER BY turn) AS anchor FROM gate),
    e AS (SELECT *, coalesce(list_filter({_ENT}, lambda x: contains(x, '条'))[1], '') AS law, coalesce(list_filter({_ENT}, lambda x: NOT contains(x, '条'))[1], '') AS topic,
      CASE WHEN {_TRIM} = '' THEN q ELSE {_TRIM} END AS core FROM a)
    SELECT qid, CASE WHEN q = '' OR NOT needed THEN q
      WHEN contains(q, '明确说不履行') OR contains(q, '不履行了呢') THEN {sql_text(fv.REWRITE_TEMPLATES['refusal'])}
      WHEN contains(q, '这种情况') AND contains(q, '可得利益') THEN {sql_text(fv.REWRITE_TEMPLATES['expected_profit'])}
      WHEN {sql_contains_any('q', ['没有登记', '未登记'])} AND {sql_contains_any('q', ['产权', '房子', '物权'])} THEN {sql_text(fv.REWRITE_TEMPLATES['registration'])}
      WHEN topic <> '' AND law <> '' THEN '围绕' || topic || '，结合' || law || '，' || core || '？' WHEN topic <> '' THEN '关于' || topic || '，' || core || '？'
      WHEN coalesce(anchor, '') <> '' THEN '基于上一轮问题“' || anchor || '”，' || core || '？' ELSE q END AS rewritten FROM e""",
)
def query_rewrite(spark, sf):
    """Every user question anchored at the previous one of its conversation."""
    asked = previous_value(
        questions(spark, sf).withColumn("said", tx.strip(F.col("query"))), "conv_id", "turn", "said", "anchor"
    )
    turns = F.floor(F.col("turn") / 2)
    signals = qn.rewrite_signals(F.col("query"), turns)
    rows = asked.withColumn(
        "needed", qn.needs_rewrite(F.col("query"), signals, turns, F.lit(False))
    )
    done = compute_once(rows, r=qn.rewrite(F.col("query"), F.col("anchor"), F.lit(""), F.col("needed")))
    return done.select("qid", F.col("r.rewritten_query").alias("rewritten"))


@query(
    "last_user_queries",
    f"""WITH u AS (SELECT conv_id, turn, {sql_strip('text')} AS t FROM conversations WHERE role = 'user'), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM u WHERE t <> '')
    SELECT conv_id, turn, recency, md5(t) AS text FROM r WHERE recency <= 2""",
)
def last_user_queries(spark, sf):
    rows = qn.last_user_queries(table(spark, sf, "conversations"), "conv_id", "turn")
    return rows.select("conv_id", "turn", "recency", F.md5("text").alias("text"))


@query("question_intent", f"WITH {_Q} SELECT qid, CASE WHEN {sql_contains_any('lower(query)', fv.REASONING_WORDS)} THEN 'legal_reasoning' ELSE 'fact_lookup' END AS intent FROM q")
def question_intent(spark, sf):
    return questions(spark, sf).select("qid", qn.intent(F.col("query")).alias("intent"))


# --- memory ---------------------------------------------------------------------------
_REC = "rec AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM conversations)"


@query("recent_messages", f"WITH {_REC} SELECT conv_id, turn, role, recency FROM rec WHERE recency <= 4")
def recent_messages(spark, sf):
    return memory.recent_messages(table(spark, sf, "conversations"), 2).select("conv_id", "turn", "role", "recency")


_STM = f"""{_REC}, tk AS (SELECT *, {sql_tokens_estimate('text')} AS tokens FROM rec WHERE recency <= 24),
su AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY recency) AS suffix_tokens FROM tk)"""


@query("token_budget_window", f"WITH {_STM} SELECT conv_id, turn, CAST(suffix_tokens AS BIGINT) AS suffix_tokens FROM su WHERE suffix_tokens <= 1800")
def token_budget_window(spark, sf):
    return memory.short_term(table(spark, sf, "conversations")).select("conv_id", "turn", "suffix_tokens")


@query(
    "memory_state",
    f"""WITH {_STM}, g AS (SELECT conv_id, count(*) AS message_count, count(*) FILTER (WHERE role = 'user') AS user_turns, CAST(sum(tokens) AS BIGINT) AS tokens FROM su WHERE suffix_tokens <= 1800 GROUP BY 1)
    SELECT *, CASE WHEN user_turns >= 6 THEN 'turn_threshold' WHEN tokens >= 1000 THEN 'token_threshold' ELSE 'none' END AS summary_trigger FROM g""",
)
def memory_state(spark, sf):
    return memory.memory_state(table(spark, sf, "conversations"))


@query("context_render", f"WITH {_REC} SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS context, CAST(sum({sql_tokens_estimate('text')}) AS BIGINT) AS context_tokens FROM rec WHERE recency <= 12 GROUP BY 1")
def context_render(spark, sf):
    out = memory.render_context(table(spark, sf, "conversations"))
    return out.select("conv_id", F.md5("context").alias("context"), "context_tokens")


_FACT = f"""fa AS (SELECT qid, conv_id, turn, replace(replace({sql_strip('query')}, '房东', '出租人'), '租客', '承租人') AS c FROM questions),
fx AS (SELECT *, regexp_extract_all(c, '([0-9]+(?:\\.[0-9]+)?\\s*(?:元|万元|万|千元))', 1)[-1] AS amount, regexp_extract_all(c, '([0-9]{{4}}年(?:[0-9]{{1,2}}月)?(?:[0-9]{{1,2}}日)?)', 1)[-1] AS time,
  list_filter({sql_list(fv.FACT_EVENTS)}, lambda e: contains(c, e) OR contains(c, replace(e, '责任', ''))) AS ev0,
  list_filter([{', '.join(f"CASE WHEN contains(c, {sql_text(k)}) THEN {sql_text(v)} END" for k, v in fv.FACT_EVENT_ALIASES.items())}], lambda x: x IS NOT NULL) AS ev1,
  list_filter({sql_list(fv.FACT_RELATIONS)}, lambda w: contains(c, w)) AS relationship, list_filter({sql_list(fv.FACT_ACTORS)}, lambda w: contains(c, w)) AS actor,
  list_filter({sql_list(fv.FACT_ROLES)}, lambda w: contains(c, w)) AS role FROM fa),
fe AS (SELECT *, list_concat(ev0, list_filter(ev1, lambda x: NOT list_contains(ev0, x))) AS event FROM fx),
fc AS (SELECT *, round(least(0.95, 0.45 + CASE WHEN len(event) > 0 THEN 0.2 ELSE 0 END + CASE WHEN amount IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN time IS NOT NULL THEN 0.1 ELSE 0 END
  + CASE WHEN len(actor) > 0 OR len(role) > 0 THEN 0.1 ELSE 0 END), 4) AS confidence FROM fe)"""


@query(
    "fact_extract",
    f"""WITH {QUESTIONS_SQL}, {_FACT} SELECT qid, coalesce(amount, '') AS amount, coalesce(time, '') AS time, array_to_string(relationship, ',') AS relationship, array_to_string(actor, ',') AS actor,
    array_to_string(role, ',') AS role, array_to_string(event, ',') AS event, CAST(confidence AS DOUBLE) AS confidence,
    CASE WHEN c = '' THEN 'unknown' WHEN len(event) > 0 THEN 'event_fact' WHEN len(relationship) > 0 THEN 'relationship_fact' ELSE 'legal_fact' END AS fact_type FROM fc""",
)
def fact_extract(spark, sf):
    rows = compute_once(questions(spark, sf), f=memory.extract_facts(F.col("query")))
    lists = [F.array_join(f"f.{n}", ",").alias(n) for n in ("relationship", "actor", "role", "event")]
    texts = [F.coalesce(f"f.{n}", F.lit("")).alias(n) for n in ("amount", "time")]
    return rows.select("qid", *texts, *lists, "f.confidence", "f.fact_type")


@query(
    "fact_lists",
    f"""WITH {QUESTIONS_SQL}, {_FACT}, u AS (SELECT conv_id, turn, 'relationship' AS key, unnest(relationship) AS value FROM fe UNION ALL SELECT conv_id, turn, 'actor', unnest(actor) FROM fe
      UNION ALL SELECT conv_id, turn, 'role', unnest(role) FROM fe UNION ALL SELECT conv_id, turn, 'event', unnest(event) FROM fe)
    SELECT conv_id, key, value, min(turn) AS first_turn FROM u GROUP BY 1, 2, 3""",
)
def fact_lists(spark, sf):
    rows = questions(spark, sf).select("conv_id", "turn", F.col("query").alias("text"))
    return memory.list_facts(rows)


_FACT_FOLD = f"""{QUESTIONS_SQL}, {_FACT}, said AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pair FROM questions),
fr AS (SELECT conv_id, turn, 'amount' AS key, amount AS value, CAST(confidence AS DOUBLE) AS confidence FROM fc WHERE amount IS NOT NULL
  UNION ALL SELECT conv_id, turn, 'time', time, CAST(confidence AS DOUBLE) FROM fc WHERE time IS NOT NULL),
numbered AS (SELECT fr.*, pair, row_number() OVER (PARTITION BY conv_id, key ORDER BY turn) AS n FROM fr JOIN said USING (conv_id, turn)),
folded AS (
  SELECT conv_id, key, n, turn AS said_at, value, confidence, pair, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value, false AS conflict, false AS uncertain FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.conv_id, x.key, x.n, x.turn,
    CASE WHEN f.value = x.value OR x.s < f.s THEN f.value ELSE x.value END,
    CASE WHEN f.value = x.value THEN greatest(f.confidence, x.confidence) WHEN x.s >= f.s THEN greatest(f.confidence, x.confidence) ELSE f.confidence END,
    CASE WHEN f.value = x.value THEN CASE WHEN x.confidence > f.confidence THEN x.pair ELSE f.pair END WHEN x.s >= f.s THEN x.pair ELSE f.pair END,
    f.value, x.value, f.value <> x.value, f.value <> x.value AND abs(x.s - f.s) < 0.05
  FROM (SELECT *, round(0.55 * confidence + 0.3 * 0.6 + 0.15 * least(1.0, 0.5 + pair / 20.0), 6) AS s FROM folded) f
  JOIN (SELECT *, round(0.55 * confidence + 0.3 * 0.6 + 0.15 * least(1.0, 0.5 + pair / 20.0), 6) AS s FROM numbered) x
    ON x.conv_id = f.conv_id AND x.key = f.key AND x.n = f.n + 1)"""


def _user_facts(spark, sf):
    return questions(spark, sf).select("conv_id", "turn", F.lit("user").alias("role"), F.col("query").alias("text"))


@query(
    "fact_conflicts",
    f"""WITH RECURSIVE {_FACT_FOLD} SELECT conv_id, key, said_at AS turn, old_value, new_value, value AS chosen, uncertain FROM folded WHERE conflict""",
)
def fact_conflicts(spark, sf):
    """Conflict log: every stated amount or time against the value kept so far."""
    events = memory.fold_facts(_user_facts(spark, sf)).select("conv_id", "key", F.explode("events").alias("e"))
    return events.select(
        "conv_id", "key", F.col("e.at").alias("turn"), "e.old_value", "e.new_value", F.col("e.chosen_value").alias("chosen"), "e.uncertain"
    )


@query(
    "fact_conflict_fold",
    f"""WITH RECURSIVE {_FACT_FOLD} SELECT conv_id, key, arg_max(value, n) AS value, round(arg_max(confidence, n), 6) AS confidence, arg_max(pair, n) AS turn, count(*) FILTER (WHERE conflict) AS conflicts
    FROM folded GROUP BY conv_id, key""",
)
def fact_conflict_fold(spark, sf):
    """The scalar facts a conversation ends with."""
    out = memory.fold_facts(_user_facts(spark, sf))
    return out.select("conv_id", "key", "value", F.round("confidence", 6).alias("confidence"), "turn", F.size("events").alias("conflicts"))


@query(
    "fact_latest",
    f"""WITH RECURSIVE {_FACT_FOLD}, l AS (SELECT *, lag(value) OVER (PARTITION BY conv_id, key ORDER BY n) AS before FROM numbered)
    SELECT conv_id, key, arg_max(value, n) AS value, count(*) FILTER (WHERE before <> value) AS conflicts FROM l GROUP BY conv_id, key""",
)
def fact_latest(spark, sf):
    """The scalar facts when the latest statement wins."""
    out = memory.fold_facts(_user_facts(spark, sf), "latest_wins")
    return out.select("conv_id", "key", "value", F.size("events").alias("conflicts"))


def _said(word: str) -> str:
    return f"bool_or(contains(role || ': ' || text, {sql_text(word)}))"


def _listed(words: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_said(w)} THEN {sql_text(w)} END" for w in words) + "], lambda x: x IS NOT NULL)"


@query(
    "conversation_summary",
    f"""WITH {QUESTIONS_SQL}, m AS (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'user' UNION ALL SELECT conv_id, turn, 'user', query FROM questions),
    g AS (SELECT conv_id, {_listed(fv.SUMMARY_TOPICS)} AS t, {_listed(fv.SUMMARY_ISSUES)} AS i, {_listed(fv.SUMMARY_LAWS)} AS l FROM m GROUP BY 1),
    o AS (SELECT conv_id, list({sql_strip('text')} ORDER BY turn DESC)[1:2] AS o FROM m WHERE role = 'user' AND (suffix({sql_strip('text')}, '？') OR suffix({sql_strip('text')}, '?')) GROUP BY 1)
    SELECT conv_id, '咨询主题：' || coalesce(t[1], '未明确') || '；已讨论问题：' || CASE WHEN len(i) > 0 THEN array_to_string(i, '、') ELSE '待补充' END || '；已引用法条：' || CASE WHEN len(l) > 0 THEN array_to_string(l, '、') ELSE '待补充' END
      || '；待解决：' || CASE WHEN len(coalesce(o, [])) > 0 THEN array_to_string(o, '；') ELSE '暂无' END AS summary_text FROM g LEFT JOIN o USING (conv_id)""",
)
def conversation_summary(spark, sf):
    said = questions(spark, sf).select("conv_id", "turn", F.lit("user").alias("role"), F.col("query").alias("text"))
    others = table(spark, sf, "conversations").filter("role <> 'user'").select("conv_id", "turn", "role", "text")
    return memory.summaries(said.unionByName(others)).select("conv_id", "summary_text")


@query("document_topics", f"WITH {QUESTIONS_SQL} SELECT qid, {sql_first_value('query', fv.TOPIC_HINTS.items(), sql_text(fv.TOPIC_OTHER))} AS topic FROM questions")
def document_topics(spark, sf):
    return questions(spark, sf).select("qid", rules.topic(F.col("query")).alias("topic"))
