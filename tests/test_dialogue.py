import random
import uuid
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillgraph.functions import fixed_values as fv
from quillgraph.operators import evaluation, feedback, memory
from quillgraph.streaming import conversation, facts, failures, ingest


def fact(value, confidence, turn, source="user"):
    return F.struct(
        F.lit(value).alias("value"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), F.lit(turn).alias("turn")
    )


def test_fact_conflict(spark):
    got = spark.range(1).select(memory.resolve(fact("a", 0.55, 1), fact("b", 0.65, 3)).alias("r")).first()["r"]
    assert got["chosen"]["value"] == "b" and got["conflict"] and not got["uncertain"]
    scores = spark.range(1).select(
        memory.fact_score(F.lit(0.55), F.lit("user"), F.lit(1)), memory.fact_score(F.lit(0.65), F.lit("user"), F.lit(3))
    ).first()
    assert tuple(scores) == pytest.approx((0.565, 0.635))
    latest = spark.range(1).select(memory.resolve(fact("a", 0.9, 9), fact("b", 0.1, 1), "latest_wins").alias("r")).first()["r"]
    assert latest["chosen"]["value"] == "b"


def streamed(spark, parts, tmp_path, name):
    """Feed the parts one after the other, restarting the stream for each, and read what was written."""
    source = tmp_path / "in"
    schema = "conv_id long, turn long, role string, text string"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        ingest.run_to_table(conversation.conversation_memory(stream), str(tmp_path / "out"), name).awaitTermination()
    return spark.read.schema(conversation.OUTPUT).parquet(str(tmp_path / "out")).orderBy("conv_id", "turn").collect()


def window_after(messages):
    """Plain short-term memory of one conversation whose summary changes at every trigger."""
    window, out = [], []
    for role, tokens in messages:
        window.append((role, tokens))
        window = window[-24:]
        while window and sum(t for _, t in window) > fv.MEMORY_MAX_TOKENS:
            window.pop(0)
        users, total = sum(r == "user" for r, _ in window), sum(t for _, t in window)
        trigger = "none"
        if role == "assistant":
            trigger = "turn_threshold" if users >= 6 else "token_threshold" if total >= 1000 else "none"
        out.append((len(window), users, total, trigger))
        if trigger != "none":
            window = window[-12:]
    return out


def test_streaming_memory_equals_fold(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for conv in range(4):
        for turn in range(conv, 30 + conv):
            if conv == 3 and turn in (9, 10, 17):
                continue
            text = "x" * rng.randrange(0, 400) + rng.choice(["", f" 金额{turn % 5}万元", f" 20{turn:02d}年3月", " 甲公司违约"])
            if turn % 2 == 0:
                text += f" 问题{turn}？"
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", text))
    parts = [[r for r in rows if r[1] < 11], [r for r in rows if 11 <= r[1] < 18], [r for r in rows if r[1] >= 18]]
    got = streamed(spark, parts, tmp_path, f"t{uuid.uuid4().hex}")
    assert [(r["conv_id"], r["turn"]) for r in got] == sorted((r[0], r[1]) for r in rows)
    assert not any(r["late"] for r in got)
    expected = []
    for conv in range(4):
        expected += window_after([(r[2], 0 if not r[3] else max(1, int(len(r[3]) * 0.6))) for r in rows if r[0] == conv])
    assert [(r["message_count"], r["user_turns"], r["tokens"], r["trigger"]) for r in got] == expected


def test_streaming_memory_shrinks_only_for_a_new_summary(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "同样的话") for t in range(24)]
    got = streamed(spark, [rows], tmp_path, f"s{uuid.uuid4().hex}")
    assert [r["turn"] for r in got if r["trigger"] == "turn_threshold"] == list(range(11, 24, 2))
    assert [r["turn"] for r in got if r["summary_updated"]] == [11]
    assert got[-1]["message_count"] == 24


def test_late_messages_are_passed_on(spark, tmp_path):
    early, late = [(1, 4, "user", "a"), (1, 5, "assistant", "b"), (1, 5, "user", "c")], [(1, 2, "user", "d"), (1, 6, "user", "e？"), (1, None, "user", "f"), (None, 1, "user", "g")]
    got = streamed(spark, [early, late], tmp_path, f"l{uuid.uuid4().hex}")
    assert sorted((r["conv_id"] or 0, -1 if r["turn"] is None else r["turn"], r["late"], r["late_count"], r["message_count"]) for r in got) == [
        (0, 1, False, 0, 1), (1, -1, True, 1, 3), (1, 2, True, 2, 3), (1, 4, False, 0, 1), (1, 5, False, 0, 2), (1, 5, False, 0, 3), (1, 6, False, 2, 4),
    ]


FACT_SCHEMA = "conv_id long, turn long, role string, text string"


def streamed_facts(spark, parts, folder, **options):
    name = f"facts-{uuid.uuid4().hex}"
    for part in parts:
        spark.createDataFrame(part, FACT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(FACT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        ingest.run_to_table(facts.conversation_facts(stream, **options), f"{folder}/out", name, rocksdb=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("seed", [1, 2])
def test_fact_stream_equals_batch_in_any_order(spark, tmp_path, seed):
    """Shuffled messages, cut into batches with a restart before each, with equal and null turns."""
    rng = random.Random(seed)
    rows = []
    for conv in (1, 2, 3, None):
        for turn in [*range(9), 4, 4, None]:
            said = rng.choice(["", "甲公司 ", "违约 ", "租赁 "]) + rng.choice(["", f"{rng.randrange(1, 4)}万元", f"20{rng.randrange(10, 13)}年3月"])
            rows.append((conv, turn, rng.choice(["user", "user", "assistant", None]), said))
    frame = spark.createDataFrame(rows, FACT_SCHEMA)
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    last = facts.latest(streamed_facts(spark, parts, tmp_path)).collect()
    assert sorted(r["messages"] for r in last) == [12] * 4
    made = {(r["conv_id"], f["key"]): (*f["kept"], [tuple(e) for e in f["events"]]) for r in last for f in r["facts"]}
    batch = {(r["conv_id"], r["key"]): (r["value"], r["confidence"], r["source"], r["turn"], [tuple(e) for e in r["events"]]) for r in memory.fold_facts(frame).collect()}
    assert made == batch
    lists = {(r["conv_id"], x["key"], x["value"], x["first_turn"]) for r in last for x in r["lists"]}
    assert {x[:3] for x in lists} == {(r["conv_id"], r["key"], r["value"]) for r in memory.list_facts(frame).collect()}
    unnumbered = {(r["conv_id"], r["key"], r["value"]) for r in memory.list_facts(frame.filter("turn is null")).collect()}
    numbered = {(r["conv_id"], r["key"], r["value"], r["first_turn"]) for r in memory.list_facts(frame.filter("turn is not null")).collect()}
    assert lists == {(*x, None) for x in unnumbered} | {x for x in numbered if x[:3] not in unnumbered}


def test_fact_state_is_read_and_written_once_a_batch():
    """However much a conversation states in a batch."""
    calls, held = [], {}

    class Handle:
        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return held.get("value")

        def update(self, value):
            calls.append("update")
            held["value"] = value

    state = facts.FactState()
    state.init(Handle())
    said = lambda turn, amount, actor: Row(turn=turn, role="user", amount=amount, time=None, confidence=0.5, source="user", relationship_facts=[], actor_facts=actor, role_facts=[], event_facts=[])
    list(state.handleInputRows((1,), iter([said(t, f"{t}元", ["甲公司", f"乙{t}"]) for t in range(2, 9)]), None))
    late = next(iter(state.handleInputRows((1,), iter([said(0, "5元", ["甲公司"])]), None)))
    assert calls == ["get", "update"] * 2
    assert (late.version, late.messages, late.stated[0], late.lists[0]) == (2, 8, (0, 0, "amount", "5元", 0.5, "user", 1), ("actor", "甲公司", 0))


def test_messages_of_one_file_are_dealt_out(spark):
    frame = spark.createDataFrame([(1, 0, "user", "3万元")], FACT_SCHEMA).coalesce(1)
    plan = facts.fact_messages(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("regexp_extract_all") <= 4


def test_failures_are_recorded_once_however_late(spark, tmp_path):
    schema = "ts timestamp, query string, failure_reason string"
    at = lambda day, hour: datetime(2024, 5, day, hour)
    parts = [
        [(at(2, 9), "q", "slow"), (at(2, 8), "q", "slow"), (at(3, 1), "q", "slow")],
        [(at(1, 5), "q", "slow"), (at(2, 7), "q", "slow"), (at(2, 7), "r", "slow"), (None, "q", "slow")],
        [(at(1, 6), "q", "slow"), (None, "q", "slow"), (at(3, 2), "q", None), (at(3, 2), "q", "other")],
    ]
    name, out = f"failures-{uuid.uuid4().hex}", str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        failures.record_daily(stream, out, name).awaitTermination()
    kind = failures.keyed_failures(spark.createDataFrame([], schema)).schema

    def table():
        return sorted(failures.recorded(spark, out, kind).select("day", "query", "failure_reason", "ts", "epoch").collect(), key=str)

    got = table()
    assert sorted((r["day"], r["query"], str(r["failure_reason"])) for r in got) == [
        ("2024-05-01", "q", "slow"), ("2024-05-02", "q", "slow"), ("2024-05-02", "r", "slow"), ("2024-05-03", "q", "None"),
        ("2024-05-03", "q", "other"), ("2024-05-03", "q", "slow"), ("unknown", "q", "slow"),
    ]
    assert {r["ts"] for r in got if (r["day"], r["query"]) == ("2024-05-02", "q")} == {at(2, 8)}
    # a batch that runs again after a lost driver changes nothing
    failures.record_batch(failures.keyed_failures(spark.createDataFrame(parts[1], schema)), 1, out)
    assert table() == got


def test_fact_fold_keeps_the_value_so_far(spark):
    rows = [
        (1, 0, "user", "租赁 甲公司 违约 5万元"), (1, 1, "assistant", "3万元"), (1, 2, "user", "3万元"), (1, 4, "user", "租赁 违约 甲公司 7万元"),
        (2, 0, "user", "2020年3月"), (2, 2, "user", "2020年3月 违约"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = {(r["conv_id"], r["key"]): r for r in memory.fold_facts(frame).collect()}
    log = [(e["at"], e["old_value"], e["new_value"], e["chosen_value"]) for e in made[1, "amount"]["events"]]
    assert log == [(1, "5万元", "3万元", "5万元"), (2, "5万元", "3万元", "5万元"), (4, "5万元", "7万元", "7万元")]
    assert made[2, "time"]["events"] == [] and made[2, "time"]["turn"] == 2
    latest = {(r["conv_id"], r["key"]): r["value"] for r in memory.fold_facts(frame, "latest_wins").collect()}
    assert latest[1, "amount"] == "7万元"


def test_document_stream_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("y" * 500)
    chunks = ingest.chunk_stream(ingest.document_stream(spark, str(tmp_path / "in")))
    ingest.run_to_table(chunks, str(tmp_path / "out"), f"ingest-{uuid.uuid4().hex}").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_hit_rates(spark):
    def rate(expected, found):
        a = F.array(*[F.lit(x) for x in expected]) if expected else F.array().cast("array<string>")
        return spark.range(1).select(evaluation.entity_hit_rate(a, F.array(*[F.lit(x) for x in found]))).first()[0]

    assert rate([], ["x"]) == 1.0
    assert rate(["A", "q"], ["xay"]) == 0.5


def test_citation_coverage(spark):
    claims = F.array(
        F.struct(F.lit("one two").alias("claim"), F.array(F.lit("e1")).alias("ids")),
        F.struct(F.lit("zzz").alias("claim"), F.array(F.lit("e9")).alias("ids")),
    )
    cites = F.array(F.struct(F.lit("e1").alias("id"), F.lit("snippet").alias("blob")))
    none = F.array().cast("array<string>")
    assert spark.range(1).select(evaluation.citation_coverage(claims, cites, none)).first()[0] == 0.5


def test_empty_bucket_is_zero(spark):
    df = spark.createDataFrame([("statute_lookup", 0.5)], "question_type string, evidence_path_hit_rate double")
    got = {r["question_type"]: r for r in evaluation.by_question_type(df).collect()}
    assert got["statute_lookup"]["retrieval_hit_rate"] == 0.5
    assert got["case_reasoning"]["sample_count"] == 0 and got["case_reasoning"]["retrieval_hit_rate"] == 0.0


def test_action_queue_ties_sort_by_priority_name(spark):
    rows = [(f"s{i}", "other", p, "open") for i, p in enumerate(["high", "low", "medium"])] + [("c", "other", "high", "closed")]
    df = spark.createDataFrame(rows, "suggestion_id string, suggestion_type string, suggested_priority string, status string")
    none = spark.createDataFrame([], "primary_failure_type string, pressure double")
    got = feedback.action_queue(df, none).collect()
    assert [r["suggested_priority"] for r in got] == ["high", "medium", "low"]
    assert got[0]["action_score"] == 0.73


def test_loop_fallback_only_without_earlier_candidates(spark):
    rows = [(i, "甲", "无") for i in range(3)] + [(10 + i, "乙", "无") for i in range(3)] + [(20, "丙", "法院")]
    df = spark.createDataFrame(rows, "ord long, topic string, original_query string")
    got = {(r["topic"], r["candidate_type"], r["suggested_priority"]) for r in feedback.loop_candidates(df, "ord").collect()}
    assert got == {("甲", "faq", "medium"), ("丙", "case", "medium")}


def test_previous_value_equals_lag(spark):
    from pyspark.sql import Window

    from quillgraph.operators.skew import previous_value

    rng = random.Random(4)
    rows = [(rng.randrange(3), t, f"v{t}") for t in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "k int, t long, v string")
    expected = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("t")))
    got = previous_value(df, "k", "t", "v", "p", block=40)
    assert sorted(map(str, got.select("k", "t", "p").collect())) == sorted(map(str, expected.select("k", "t", "p").collect()))
