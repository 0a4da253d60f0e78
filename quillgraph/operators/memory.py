"""Conversation memory over a message table (conv_id, turn, role, text).

Every window is cut by a descending row number before anything is summed, so a
very long conversation is reduced to its bounded tail inside the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import fixed_values as fv
from quillgraph.functions import rules
from quillgraph.functions import text as tx
from quillgraph.session import compute_once

ORDER = ("conv_id", "turn")
SCALAR_FACTS = ("amount", "time")
LIST_FACTS = ("relationship", "actor", "role", "event")


def recent_messages(messages: DataFrame, window: int = fv.MEMORY_WINDOW) -> DataFrame:
    """Last ``2 * window`` messages of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= max(2, 2 * window))


def short_term(
    messages: DataFrame, max_turns: int = fv.MEMORY_MAX_TURNS, max_tokens: int = fv.MEMORY_MAX_TOKENS
) -> DataFrame:
    """What the count limit and the token budget leave of each conversation.

    Both limits drop from the front, so what stays is the shorter of two suffixes.
    """
    tail = recent_messages(messages, max_turns).withColumn("tokens", tx.estimate_tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("recency").rowsBetween(Window.unboundedPreceding, 0)
    return tail.withColumn("suffix_tokens", F.sum("tokens").over(order)).filter(F.col("suffix_tokens") <= max_tokens)


def memory_state(messages: DataFrame) -> DataFrame:
    """Per conversation: kept messages, user turns, tokens and the summary trigger."""
    state = short_term(messages).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
        F.sum("tokens").alias("tokens"),
    )
    return state.withColumn(
        "summary_trigger",
        F.when(F.col("user_turns") >= fv.SUMMARY_TURNS, "turn_threshold")
        .when(F.col("tokens") >= fv.SUMMARY_TOKENS, "token_threshold")
        .otherwise("none"),
    )


def user_turn_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"))


# --- facts --------------------------------------------------------------------------
def extract_facts(c: Column) -> Column:
    """struct of amount, time, relationship, actor, role, event, type and confidence."""
    content = tx.replace_all(tx.strip(tx.text_or_empty(c)), fv.FACT_ALIASES)
    blank = content == ""

    def last(pattern: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), F.lit(-1))

    amount, time = last("(?U)" + fv.AMOUNT_PATTERN), last(fv.TIME_PATTERN)
    events = F.filter(
        F.array(*[F.lit(e) for e in fv.FACT_EVENTS]),
        lambda e: F.contains(content, e) | F.contains(content, F.replace(e, F.lit(fv.FACT_EVENT_SUFFIX), F.lit(""))),
    )
    by_alias = F.array_compact(
        F.array(*[F.when(content.contains(a), F.lit(e)) for a, e in fv.FACT_EVENT_ALIASES.items()])
    )
    events = F.array_union(events, by_alias)
    relations = tx.matching_words(content, fv.FACT_RELATIONS)
    actors = tx.matching_words(content, fv.FACT_ACTORS)
    roles = tx.matching_words(content, fv.FACT_ROLES)
    w = fv.FACT_CONFIDENCE

    def bonus(condition: Column, name: str) -> Column:
        return F.when(condition, w[name]).otherwise(0.0)

    confidence = (
        F.lit(w["base"])
        + bonus(F.size(events) > 0, "event")
        + bonus(amount.isNotNull(), "amount")
        + bonus(time.isNotNull(), "time")
        + bonus((F.size(actors) > 0) | (F.size(roles) > 0), "actor")
    )
    return F.struct(
        F.when(blank, "unknown").when(F.size(events) > 0, "event_fact").when(F.size(relations) > 0, "relationship_fact")
        .otherwise("legal_fact").alias("fact_type"),
        amount.alias("amount"),
        time.alias("time"),
        relations.alias("relationship"),
        actors.alias("actor"),
        roles.alias("role"),
        events.alias("event"),
        F.when(blank, w["empty"]).otherwise(F.round(F.least(F.lit(w["cap"]), confidence), 4)).alias("confidence"),
    )


def fact_source(role: Column) -> Column:
    r = F.lower(tx.text_or_empty(role))
    return F.when(r.isin("assistant", "user"), r).otherwise("unknown")


def fact_score(confidence: Column, source: Column, turn: Column) -> Column:
    w = fv.FACT_SCORE_WEIGHTS
    reliability = rules.lookup(source, fv.SOURCE_RELIABILITY, fv.SOURCE_RELIABILITY["unknown"])
    recency = F.least(F.lit(1.0), 0.5 + turn / 20.0)
    return F.round(w["confidence"] * confidence + w["source"] * reliability + w["recency"] * recency, 6)


def resolve(old: Column, new: Column, strategy: str = "confidence_weighted") -> Column:
    """struct(chosen, uncertain, conflict) of two fact structs (value, confidence, source, turn).

    The newer fact wins ties and keeps the larger confidence.
    """
    conflict = old["value"] != new["value"]
    surer = F.when(new["confidence"] > old["confidence"], new).otherwise(old)
    if strategy == "latest_wins":
        latest = F.when(conflict, new).otherwise(surer)
        return F.struct(latest.alias("chosen"), F.lit(False).alias("uncertain"), conflict.alias("conflict"))
    old_score = fact_score(old["confidence"], old["source"], old["turn"])
    new_score = fact_score(new["confidence"], new["source"], new["turn"])
    raised = F.struct(
        new["value"].alias("value"),
        F.greatest(new["confidence"], old["confidence"]).alias("confidence"),
        new["source"].alias("source"),
        new["turn"].alias("turn"),
    )
    chosen = (
        F.when(~conflict, surer)
        .when(new_score >= old_score, raised)
        .otherwise(old)
    )
    uncertain = conflict & (F.abs(new_score - old_score) < fv.FACT_UNCERTAIN_GAP)
    return F.struct(chosen.alias("chosen"), uncertain.alias("uncertain"), conflict.alias("conflict"))


def list_facts(messages: DataFrame) -> DataFrame:
    """(conv_id, key, value, first_turn): union of list-valued facts, first seen first.

    One row per distinct value; nothing is collected per conversation.
    """
    facts = compute_once(messages.select("conv_id", "turn", "text"), f=extract_facts(F.col("text")))
    keyed = F.concat(*[_tagged(key) for key in ("relationship", "actor", "role", "event")])
    return (
        facts.select("conv_id", "turn", F.explode(keyed).alias("kv"))
        .groupBy("conv_id", F.col("kv.key").alias("key"), F.col("kv.value").alias("value"))
        .agg(F.min("turn").alias("first_turn"))
    )


def _tagged(key: str) -> Column:
    return F.transform(F.col(f"f.{key}"), lambda v: F.struct(F.lit(key).alias("key"), v.alias("value")))


def scalar_fact_rows(messages: DataFrame) -> DataFrame:
    """(conv_id, key, turn, value, confidence, source) of every stated amount and time."""
    numbered = ["pair"] if "pair" in messages.columns else []
    facts = compute_once(messages.select("conv_id", "turn", "role", "text", *numbered), f=extract_facts(F.col("text")))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"f.{k}").alias("value")) for k in SCALAR_FACTS])
    return facts.select(
        "conv_id", "turn", *numbered, fact_source(F.col("role")).alias("source"), F.col("f.confidence").alias("confidence"),
        F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("kv"),
    ).select("conv_id", F.col("kv.key").alias("key"), "turn", F.col("kv.value").alias("value"), "confidence", "source", *numbered)


def fold_facts(messages: DataFrame, strategy: str = "confidence_weighted") -> DataFrame:
    """(conv_id, key, value, confidence, source, turn, events): scalar facts folded over the whole conversation.

    Every stated value meets the value kept so far, in the order of turns (a
    null turn first), user before assistant.  The turn of a fact is the number
    of its user-assistant pair, from 1.  ``events`` logs the conflicts: message
    turn, old, new and chosen value, uncertainty.  Only the stated facts of a
    conversation come together, as short structs.
    """
    pair = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(
        Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    )
    stated = scalar_fact_rows(messages.withColumn("pair", F.greatest(F.lit(1), pair).cast("int")))
    fact = F.struct("value", "confidence", "source", F.col("pair").alias("turn"))
    second = F.when(F.col("source") == "user", 0).otherwise(1)
    listed = stated.groupBy("conv_id", "key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn").alias("at"), second.alias("second"), fact.alias("fact")))).alias("facts")
    )
    out = listed.select("conv_id", "key", folded(F.col("facts"), strategy).alias("r"))
    return out.select("conv_id", "key", "r.kept.*", "r.events")


def folded(facts: Column, strategy: str = "confidence_weighted") -> Column:
    """struct(kept, events) of a non-empty array of stated facts (at, second, fact), which are in order."""
    event = "struct<at:bigint,old_value:string,new_value:string,chosen_value:string,uncertain:boolean>"
    kind = "struct<value:string,confidence:double,source:string,turn:int>"
    first = F.struct(F.get(facts, 0)["fact"].cast(kind).alias("kept"), F.array().cast(f"array<{event}>").alias("events"))

    def step(acc: Column, x: Column) -> Column:
        def with_result(r: Column) -> Column:
            logged = F.struct(
                x["at"].cast("bigint").alias("at"), acc["kept"]["value"].alias("old_value"), x["fact"]["value"].alias("new_value"),
                r["chosen"]["value"].alias("chosen_value"), r["uncertain"].alias("uncertain"),
            ).cast(event)
            return F.struct(
                r["chosen"].cast(kind).alias("kept"),
                F.when(r["conflict"], F.concat(acc["events"], F.array(logged))).otherwise(acc["events"]).alias("events"),
            )

        return F.get(F.transform(F.array(resolve(acc["kept"], x["fact"].cast(kind), strategy)), with_result), F.lit(0))

    return F.aggregate(F.slice(facts, F.lit(2), F.greatest(F.lit(0), F.size(facts) - 1)), first, step)


# --- summary --------------------------------------------------------------------------
def summaries(messages: DataFrame) -> DataFrame:
    """Topic, issues, laws and the last two open user questions per conversation.

    Built from flags and bounded top-2 rows, not from a collected transcript.
    """
    line = F.concat(F.col("role"), F.lit(": "), tx.text_or_empty(F.col("text")))
    words = list(dict.fromkeys(fv.SUMMARY_TOPICS + fv.SUMMARY_ISSUES + fv.SUMMARY_LAWS))
    flags = messages.groupBy("conv_id").agg(
        *[F.bool_or(line.contains(w)).alias(f"w{i}") for i, w in enumerate(words)]
    )

    def mentioned(chosen: list[str]) -> Column:
        return F.array_compact(F.array(*[F.when(F.col(f"w{words.index(w)}"), F.lit(w)) for w in chosen]))

    said = tx.strip(tx.text_or_empty(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    open_questions = (
        messages.filter((F.col("role") == "user") & (said.endswith("？") | said.endswith("?")))
        .select("conv_id", said.alias("q"), F.row_number().over(order).alias("n"))
        .filter("n <= 2")
        .groupBy("conv_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "q"))), lambda s: s["q"]).alias("unresolved_questions"))
    )
    out = flags.join(open_questions, "conv_id", "left").select(
        "conv_id",
        F.coalesce(F.get(mentioned(fv.SUMMARY_TOPICS), 0), F.lit(fv.SUMMARY_NO_TOPIC)).alias("topic"),
        mentioned(fv.SUMMARY_ISSUES).alias("discussed_issues"),
        mentioned(fv.SUMMARY_LAWS).alias("cited_laws"),
        F.coalesce("unresolved_questions", F.array().cast("array<string>")).alias("unresolved_questions"),
    )
    return out.withColumn(
        "summary_text",
        summary_text(F.col("topic"), F.col("discussed_issues"), F.col("cited_laws"), F.col("unresolved_questions")),
    )


def summary_text(topic: Column, issues: Column, laws: Column, open_questions: Column) -> Column:
    def listed(values: Column, separator: str, empty: str) -> Column:
        return F.when(F.size(values) > 0, F.array_join(values, separator)).otherwise(empty)

    return F.concat(
        F.lit("咨询主题："), topic,
        F.lit("；已讨论问题："), listed(issues, "、", fv.SUMMARY_TO_FILL),
        F.lit("；已引用法条："), listed(laws, "、", fv.SUMMARY_TO_FILL),
        F.lit("；待解决："), listed(open_questions, "；", fv.SUMMARY_NONE_OPEN),
    )


def render_context(messages: DataFrame) -> DataFrame:
    """``role: text`` lines of the recent window, one string per conversation."""
    recent = recent_messages(messages)
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return recent.groupBy("conv_id").agg(
        F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("context"),
        F.sum(tx.estimate_tokens(F.col("text"))).alias("context_tokens"),
    )


def lru_keep(entries: DataFrame, capacity: int, used: str = "last_used") -> DataFrame:
    """The ``capacity`` most recently used cache entries."""
    return entries.orderBy(F.desc(used)).limit(capacity)
