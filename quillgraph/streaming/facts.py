"""Facts of conversations as keyed state that takes late messages in their place.

The state of a conversation holds what was stated, how many user messages
each turn had and where each list-valued fact was first said.  All of it is
needed for every new version, so it is one value: a conversation is read and
written once a batch, whatever its messages say.  A message that comes late, or twice in one turn, is put where its turn
and role belong; what the conversation's facts come to is then worked out anew
by the same expression as in batch (``memory.folded``), so the last version of
a conversation depends on its messages and not on their order of arrival.

A null turn stands before all others.  The state is of the RocksDB kind
(``ingest.run_to_table(..., rocksdb=True)``); it follows what was stated, in
short rows, and is kept as long as the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillgraph.functions import text as tx
from quillgraph.operators import memory
from quillgraph.session import bound, compute_once

STATED = "at bigint, second int, key string, value string, confidence double, source string"
USERS = "turn bigint, n int"
LISTS = "at bigint, second int, place int, key string, value string"


def _array(fields: str, more: str = "") -> str:
    return f"array<struct<{fields.replace(', ', ',').replace(' ', ':')}{more}>>"


STATE = f"messages bigint, version bigint, stated {_array(STATED)}, users {_array(USERS)}, lists {_array(LISTS)}"
OUTPUT = (
    f"conv_id bigint, version bigint, messages bigint, stated {_array(STATED, ',pair:int')}, "
    "lists array<struct<key:string,value:string,first_turn:bigint>>"
)
NO_TURN = -(1 << 63)


class FactState(StatefulProcessor):
    """Gathers what a conversation stated; every batch with messages of it gives one new version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("facts", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        messages, version, *before = self.state.get() or (0, 0, [], [], [])
        stated, counted, listed = ([tuple(x) for x in part] for part in before)
        users, lists = dict(counted), {x[3:]: x[:3] for x in listed}
        for row in rows:
            messages += 1
            at, second = NO_TURN if row.turn is None else row.turn, 0 if row.role == "user" else 1
            if row.role == "user":
                users[at] = users.get(at, 0) + 1
            stated += [(at, second, k, row[k], row.confidence, row.source) for k in memory.SCALAR_FACTS if row[k] is not None]
            for k in memory.LIST_FACTS:
                for place, value in enumerate(row[f"{k}_facts"]):
                    lists[k, value] = min(lists.get((k, value), (at, second, place)), (at, second, place))
        stated.sort()
        counts, firsts = sorted(users.items()), sorted((*first, *name) for name, first in lists.items())
        self.state.update((messages, version + 1, stated, counts, firsts))
        yield self._row(key, version + 1, messages, stated, counts, firsts)

    def _row(self, key: tuple, version: int, messages: int, facts: list[tuple], counts: list[tuple], firsts: list[tuple]) -> Row:
        stated, pair, at = [], 0, 0
        for fact in facts:
            while at < len(counts) and counts[at][0] <= fact[0]:
                pair, at = pair + counts[at][1], at + 1
            stated.append((None if fact[0] == NO_TURN else fact[0], *fact[1:], max(1, pair)))
        lists = [(k, value, None if first == NO_TURN else first) for first, _, _, k, value in firsts]
        return Row(conv_id=key[0], version=version, messages=messages, stated=stated, lists=lists)

    def close(self) -> None:
        pass


def fact_messages(messages: DataFrame) -> DataFrame:
    """What the state needs of each message; extraction stays in the JVM.

    A batch may be one file, so its messages are dealt out before they are read.
    """
    dealt = messages.select("conv_id", "turn", "role", "text").repartition(F.xxhash64("conv_id", "turn"))
    return compute_once(dealt, f=memory.extract_facts(F.col("text"))).select(
        "conv_id", "turn", "role", *[F.col(f"f.{k}").alias(k) for k in memory.SCALAR_FACTS],
        *[F.col(f"f.{k}").alias(f"{k}_facts") for k in memory.LIST_FACTS], F.col("f.confidence").alias("confidence"),
        memory.fact_source(F.col("role")).alias("source"),
    )


def conversation_facts(messages: DataFrame, strategy: str = "confidence_weighted") -> DataFrame:
    """Message stream (conv_id, turn, role, text) -> one row per conversation and micro-batch that touched it.

    ``facts`` has an entry per scalar fact (key, value, confidence, source,
    turn, events), ``lists`` the list facts in the order they were first said;
    the largest ``version`` of a conversation is its present state.
    """
    kept = fact_messages(messages).groupBy("conv_id").transformWithState(
        FactState(), OUTPUT, "Append", "None"
    )

    def of_key(key: str):
        def of_stated(own: Column) -> Column:
            facts = F.transform(
                own, lambda s: F.struct(s["at"].alias("at"), s["second"].alias("second"), F.struct(s["value"], s["confidence"], s["source"], s["pair"].alias("turn")).alias("fact"))
            )
            one = bound(memory.folded(facts, strategy), lambda r: F.struct(F.lit(key).alias("key"), r["kept"].alias("kept"), r["events"].alias("events")))
            return F.when(F.size(own) > 0, one)

        return bound(F.filter("stated", lambda s: s["key"] == key), of_stated)

    facts = F.array_compact(F.array(*[of_key(k) for k in memory.SCALAR_FACTS]))
    return kept.select("conv_id", "version", "messages", facts.alias("facts"), "lists")


def latest(versions: DataFrame) -> DataFrame:
    """The present state of every conversation from the rows the stream has written."""
    newest = versions.groupBy("conv_id").agg(F.max("version").alias("newest")).withColumnRenamed("conv_id", "__conv")
    mine = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("version") == F.col("newest"))
    return versions.join(newest, mine).select(*versions.columns)
