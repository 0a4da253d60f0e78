"""Streaming short-term memory and summary of conversations.

State per conversation is bounded: the short-term window (24 messages, 1800
tokens), the summary text and a few counters.  Nothing waits for missing turns:
messages are folded in the order of their turns within what has arrived, a null
turn first.  One that arrives after a later one was folded is passed on marked
``late`` and counted; it no longer enters the window.  Every input row gives one
output row.  What messages state as facts is kept elsewhere, late ones included
(``streaming.facts``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgraph.functions import fixed_values as fv
from quillgraph.functions import text as tx

OUTPUT = (
    "conv_id bigint, turn bigint, message_count int, user_turns int, tokens int, trigger string, summary_updated boolean, "
    "summary string, late boolean, late_count int"
)
STATE = "memory string"
SUMMARY_WORDS = list(dict.fromkeys(fv.SUMMARY_TOPICS + fv.SUMMARY_ISSUES + fv.SUMMARY_LAWS))


def _summary(window: list[dict]) -> str:
    """Summary of the window's messages, as ``memory.summaries`` words it."""
    said = {word for message in window for word in message["words"]}
    asked = [message["question"] for message in reversed(window) if message["question"]][:2]

    def listed(words: list[str], separator: str, empty: str) -> str:
        return separator.join(words) or empty

    topic = next((w for w in fv.SUMMARY_TOPICS if w in said), fv.SUMMARY_NO_TOPIC)
    issues = listed([w for w in fv.SUMMARY_ISSUES if w in said], "、", fv.SUMMARY_TO_FILL)
    laws = listed([w for w in fv.SUMMARY_LAWS if w in said], "、", fv.SUMMARY_TO_FILL)
    return f"咨询主题：{topic}；已讨论问题：{issues}；已引用法条：{laws}；待解决：{listed(asked, '；', fv.SUMMARY_NONE_OPEN)}"


def fold(state: dict, message: dict) -> dict:
    """Take one message into ``state`` and return what is reported about it."""
    place = [message["turn"] is not None, message["turn"] or 0, message["role"] != "user"]
    late = state["last"] is not None and place < state["last"]
    trigger, updated = "none", False
    if late:
        state["late"] += 1
    else:
        state["last"] = place
        window = state["window"]
        window.append({k: message[k] for k in ("role", "tokens", "words", "question")})
        del window[: -2 * fv.MEMORY_MAX_TURNS]
        while window and sum(m["tokens"] for m in window) > fv.MEMORY_MAX_TOKENS:
            window.pop(0)
        if message["role"] == "assistant":
            users = sum(m["role"] == "user" for m in window)
            tokens = sum(m["tokens"] for m in window)
            trigger = "turn_threshold" if users >= fv.SUMMARY_TURNS else "token_threshold" if tokens >= fv.SUMMARY_TOKENS else "none"
    window = state["window"]
    report = {
        "turn": message["turn"], "message_count": len(window), "user_turns": sum(m["role"] == "user" for m in window),
        "tokens": sum(m["tokens"] for m in window), "trigger": trigger,
        "late": late, "late_count": state["late"],
    }
    if trigger != "none":
        summary = _summary(window)
        updated = summary != state["summary"]
        state["summary"] = summary
        if updated:
            del window[: -2 * fv.MEMORY_WINDOW]
    return report | {"summary_updated": updated, "summary": state["summary"]}


def empty_state() -> dict:
    return {"window": [], "summary": "", "late": 0, "last": None}


def update_conversation(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold what has arrived, in the order of turns; one output row per message."""
    kept = json.loads(state.get[0]) if state.exists else empty_state()
    arrived = pd.concat(list(batches))
    arrived["second"] = arrived["role"] != "user"
    rows = []
    for record in arrived.sort_values(["turn", "second"], kind="stable", na_position="first").to_dict("records"):
        message = {k: (list(v) if hasattr(v, "tolist") and not isinstance(v, str) and getattr(v, "ndim", 0) else v) for k, v in record.items()}
        message["tokens"], message["turn"] = int(message["tokens"]), None if pd.isna(message["turn"]) else int(message["turn"])
        rows.append(fold(kept, message))
    state.update((json.dumps(kept, ensure_ascii=False),))
    out = pd.DataFrame(rows).astype({"turn": "Int64"})
    out.insert(0, "conv_id", pd.array([key[0]] * len(out), "Int64"))
    yield out[[c.split()[0] for c in OUTPUT.split(", ")]]


def prepared_messages(messages: DataFrame) -> DataFrame:
    """What the fold needs of each message; all regex and word matching stays in the JVM."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), tx.text_or_empty(F.col("text")))
    said = tx.strip(tx.text_or_empty(F.col("text")))
    asked = (F.col("role") == "user") & (said.endswith("？") | said.endswith("?"))
    return messages.select(
        "conv_id", "turn", "role", tx.estimate_tokens(F.col("text")).alias("tokens"),
        tx.matching_words(line, SUMMARY_WORDS).alias("words"), F.when(asked, said).alias("question"),
    )


def conversation_memory(messages: DataFrame) -> DataFrame:
    """Streaming plan: message stream (conv_id, turn, role, text) -> memory rows."""
    return prepared_messages(messages).groupBy("conv_id").applyInPandasWithState(
        update_conversation, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
