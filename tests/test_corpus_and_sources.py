import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillgraph.plans import corpus
from quillgraph.sources import files, generators, sinks, tables


def test_round_three_counts(spark):
    prepared = corpus.prepare_corpus(generators.statutes(spark), generators.cases(spark), generators.faqs(spark))
    assert {n: df.count() for n, df in prepared.layers.items()} == {"statutes": 220, "cases": 220, "faqs": 70}
    removed = {n: {r["reason"]: r["removed"] for r in df.collect()} for n, df in prepared.removed.items()}
    assert removed == {
        "statutes": {"duplicate_article_no": 20},
        "cases": {"duplicate_case_id": 20},
        "faqs": {"duplicate_question_exact": 10},
    }
    assert all(v == 0 for df in prepared.missing.values() for v in df.first())
    assert all(v == 0 for df in prepared.lengths.values() for v in df.first())
    assert all(df.first()["conflicts"] == 0 for df in prepared.conflicts.values())


def test_first_round_has_no_structured_columns(spark):
    prepared = corpus.prepare_corpus(generators.statutes(spark), generators.cases(spark), generators.faqs(spark), "round1")
    assert "law_name" not in prepared.layers["statutes"].columns and prepared.layers["faqs"].count() == 80


def docx_bytes(lines):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in lines)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
    return buffer.getvalue()


def test_directory_loader(spark, tmp_path):
    (tmp_path / "b.txt").write_text("﻿hello", encoding="utf-8")
    (tmp_path / "a.txt").write_text("first", encoding="utf-8")
    (tmp_path / "blank.txt").write_text(" \n", encoding="utf-8")
    (tmp_path / "c.docx").write_bytes(docx_bytes(["one", " ", "two"]))
    rows = files.load_documents(spark, str(tmp_path)).orderBy("ord", "path").collect()
    assert [(r["doc_id"], r["title"]) for r in rows] == [("a", "a.txt"), ("b", "b.txt"), ("c", "c.docx")]
    assert rows[1]["text"] == "﻿hello" and rows[2]["text"] == "one\ntwo"
    with pytest.raises(ValueError):
        files.load_document(spark, "x.html")


def test_record_loaders(spark, tmp_path):
    (tmp_path / "faqs_raw_round1.jsonl").write_text('{"faq_id":"1","question":"q"}\n\nnot json\n{"faq_id":"2"}\n')
    (tmp_path / "faqs_raw_round2.json").write_text('[{"faq_id":"3","topic":"t"}]')
    assert files.load_raw_items(spark, str(tmp_path), "round1", files.FAQ).count() == 2
    assert [r["topic"] for r in files.load_raw_items(spark, str(tmp_path), "round2", files.FAQ).collect()] == ["t"]
    assert files.load_raw_items(spark, str(tmp_path), "round9", files.FAQ).count() == 3
    assert files.load_raw_items(spark, str(tmp_path / "none"), "round1", files.FAQ).count() == 0


def test_benchmark_loader(spark, tmp_path):
    rows = [{"id": 1, "category": "法条定位类", "query": " q "}, {"id": 2, "query": "x", "requires_multiturn": True}]
    (tmp_path / "a.json").write_text(json.dumps(rows, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps({"examples": rows}, ensure_ascii=False))
    for name in ("a.json", "b.json"):
        got = files.load_benchmark(spark, str(tmp_path / name)).orderBy("id").collect()
        assert [(r["query"], r["question_type"], r["source_type"], r["expected_retrieval_strategy"]) for r in got] == [
            ("q", "statute_lookup", "statute_only", "graph"),
            ("x", "multiturn_followup", "hybrid", "hybrid"),
        ]


def test_archive_and_runtime_failures(spark, tmp_path):
    rows = [("f1", "q1", "Low Grounding", "a", "", "2024-01-01T00:00:00"), ("f2", "q1", "Low Grounding", "b", "s", "2024-01-01T00:00:00")]
    df = spark.createDataFrame(rows, "failure_id string, query string, failure_reason string, question_type string, source_type string, timestamp string")
    sinks.archive_failures(df, str(tmp_path / "archive"))
    index = {(r["kind"], r["value"]): r["n"] for r in sinks.archive_index(spark.read.json(str(tmp_path / "archive"))).collect()}
    assert index[("reason", "low_grounding")] == 2 and index[("source_type", "unknown")] == 1
    target = str(tmp_path / "runtime")
    assert sinks.append_runtime_failures(df, target, "2024-01-01").count() == 1
    assert sinks.append_runtime_failures(df, target, "2024-01-01").count() == 0
    assert sinks.append_runtime_failures(df, target, "2024-01-02").count() == 1


def test_status_round_trip(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"a": "Closed", "b": "?"}')
    statuses = files.load_status(spark, str(tmp_path / "s.json"))
    assert {r[0]: r[1] for r in statuses.collect()} == {"a": "closed", "b": "open"}
    sinks.save_status(statuses, str(tmp_path / "v1"))
    sinks.update_status(spark, str(tmp_path / "v1"), str(tmp_path / "v2"), "b", "in_progress")
    assert {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "v2")).collect()} == {"a": "closed", "b": "in_progress"}
    assert files.load_status(spark, str(tmp_path / "missing.json")).count() == 0


def test_index_and_graph_round_trip(spark, tmp_path):
    docs = generators.cases(spark).limit(12).select("doc_id", "title", F.col("content").alias("text"), "source_type")
    chunks, kg = tables.index_and_graph(docs, str(tmp_path / "store"))
    again, kg2 = tables.index_and_graph(docs, str(tmp_path / "store"))
    assert chunks.count() == again.count() > 12
    assert kg.edges.count() == kg2.edges.count() > 0
