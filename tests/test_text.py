import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import fixed_values as fv
from quillgraph.functions import ids, rules
from quillgraph.functions import text as tx
from quillgraph.functions import vectors as vx
from quillgraph.operators import chunking, knowledge_base


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


def test_clean_drops_title_header_and_page_lines(spark):
    content = (
        "中华人民共和国刑法第201条\n第1页 共50页\n中华人民共和国刑法\n【盗窃罪】财产犯罪相关规则。\n"
        "第201条：行为人实施与盗窃罪相关的行为，依法承担相应法律责任。\n"
        "在情节、后果、主观状态等因素下，人民法院应结合证据依法认定。\n页码:1\n"
    )
    got = one(spark, content, lambda c: tx.clean_document_text(c, F.lit("中华人民共和国刑法第201条")))
    assert got.split("\n") == [
        "【盗窃罪】财产犯罪相关规则。",
        "第201条：行为人实施与盗窃罪相关的行为，依法承担相应法律责任。",
        "在情节、后果、主观状态等因素下，人民法院应结合证据依法认定。",
    ]


def test_clean_keeps_bare_site_name_and_collapses_marks(spark):
    assert one(spark, "中国裁判文书网\na,,b\r\n a \na", tx.clean_document_text) == "中国裁判文书网\na，b\na"


def test_tokens_and_claims(spark):
    assert one(spark, "盗窃罪 law", tx.search_tokens) == ["盗窃罪", "盗窃", "窃罪", "law"]
    assert one(spark, "甲并且乙。丙；丁且戊", tx.claims) == ["甲", "乙", "丙", "丁"]
    assert [one(spark, s, tx.estimate_tokens) for s in ("", "abc", "x" * 10)] == [0, 1, 6]


def test_char_jaccard(spark):
    df = spark.createDataFrame([("abcc", "bcd"), ("é", "è"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(tx.char_jaccard(F.col("a"), F.col("b"))).collect()]
    assert got == [0.5, 0.0, 1.0]


@pytest.mark.parametrize(
    "n,zh", [(264, "二百六十四"), (1165, "一千一百六十五"), (10, "十"), (105, "一百零五"), (110, "一百十"), (0, "零")]
)
def test_numerals(spark, n, zh):
    assert spark.range(1).select(tx.chinese_numeral(F.lit(n))).first()[0] == zh


def test_article_names(spark):
    assert one(spark, "《中华人民共和国刑法》第二百六十四条", tx.normalize_article_name) == "刑法第二百六十四条"
    law = F.lit("中华人民共和国民法典")
    text = "依《中华人民共和国刑法》第三条、第四条和公司法第五条"
    assert one(spark, text, lambda c: tx.normalize_articles_in_text(c, law)) == "依刑法第三条、民法典第四条和公司法第五条"


def test_hash_buckets_equal_md5_modulo(spark):
    tokens = ["law", "the", "abc123", "盗窃", "", "ß"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = [r[0] for r in df.select(vx.hash_bucket(F.col("t"))).collect()]
    assert got == [int(hashlib.md5(t.encode()).hexdigest(), 16) % 384 for t in tokens]


def test_windows_keep_contained_tail(spark):
    spans = one(spark, "x" * 400, chunking.window_spans)
    assert [(s["start_char"], s["end_char"]) for s in spans] == [(0, 400), (320, 400)]
    assert one(spark, "", chunking.window_spans) == []
    with pytest.raises(ValueError):
        chunking.window_spans(F.lit("x"), 10, 10)


def test_articles_fill_forward(spark):
    docs = spark.createDataFrame([("law_1", "t", "序言 第一条 甲。第二款 乙。第二条 丙")], "doc_id string, title string, text string")
    rows = chunking.chunk_documents(docs).orderBy("idx").collect()
    assert [(r["section"], r["article"]) for r in rows] == [("第一条", "第一条"), ("第二款", "第一条"), ("第二条", "第二条")]
    assert all("序言" not in r["text"] for r in rows)


def test_chunks_cover_text(spark):
    text = " ".join(f"word{i}" for i in range(500))
    docs = spark.createDataFrame([("d", "t", text)], "doc_id string, title string, text string")
    rows = chunking.chunk_documents(docs).orderBy("idx").collect()
    covered = set()
    for r in rows:
        assert r["text"] in text
        covered.update(range(r["start_char"], r["end_char"]))
    assert covered == set(range(len(text)))


def test_node_id_and_evidence_id(spark):
    df = spark.createDataFrame([("Acme Corp.", "PARTY"), ("!!", "CASE")], "n string, t string")
    got = [r[0] for r in df.select(ids.node_id(F.col("n"), F.col("t"))).collect()]
    assert got == ["party::acme_corp", "case::" + hashlib.md5(b"!!").hexdigest()[:12]]


def test_strategy_rules(spark):
    cases = {
        "预期违约怎么处理": "graph",
        "王某的行为如何定性": "vector",
        "你好": "direct_answer",
        "What is this": "hybrid",
        "盗窃适用哪一条": "graph",
        "没有规则": "graph",
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    got = {r["q"]: r["s"] for r in df.select("q", rules.retrieval_strategy(F.col("q"))["retrieval_strategy"].alias("s")).collect()}
    assert got == cases


def test_knowledge_base_law(spark):
    row = ("law_1 ", "中华人民共和国民法典", "第五条", "总则", "2021-01-01", "租客应付租金,,见第六条", ["盗窃行为", "第七条", "盗窃罪"])
    df = spark.createDataFrame(
        [row],
        "doc_id string, law_name string, article_no string, chapter string, effective_date string, text string, keywords array<string>",
    )
    got = knowledge_base.clean_laws(df).first()
    assert got["article_no"] == "民法典第五条"
    assert got["text"] == "承租人应付租金,见民法典第六条"
    assert got["keywords"] == ["盗窃罪", "民法典第七条"]


def test_sentences_match_plain_split(spark):
    text = "One. Two!  三。四；\n five"
    expected = [p.strip() for p in re.split(r"(?<=[.!?。！？；;])\s*", text) if p.strip()]
    assert one(spark, text, tx.sentences) == expected


def test_collapse_space_equals_plain_replacement(spark):
    import itertools
    import re

    marks = ["a", " ", "\t", "\x1c", "\u3000", "\xa0"]
    texts = ["".join(t) for n in range(1, 6) for t in itertools.product(marks[: 6 if n < 5 else 4], repeat=n)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.collapse_space(F.col("t")).alias("c"))
    assert all(r["c"] == re.sub(r"\s+", " ", r["t"]).strip(" ") for r in frame.collect())
    # a single blank is left alone instead of being replaced by itself
    assert "| [" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_noise_lines_start_as_listed(spark):
    lines = {"第 3 页 共9页": True, "页码：12": True, "pAGE 3 / 4": True, "Page3": True, "中华人民共和国刑法": True, "最高人民法院公报": True,
             "中国裁判文书网1": True, "（以下称甲方）": True, "以下称乙方": True, "": True, "第3条": False, "Pages": False, "正文 第3页": False, "中国": False}
    frame = spark.createDataFrame([(t,) for t in lines], "t string")
    assert {r["t"]: r["n"] for r in frame.select("t", tx.noise_line(F.col("t")).alias("n")).collect()} == lines
    patterns = [p.lstrip("^").removeprefix("（?") for p in fv.PAGE_LINE_PATTERNS + fv.HEADER_LINE_PATTERNS]
    assert {p[0] for p in patterns} <= set(fv.NOISE_LINE_STARTS)


def test_law_name_is_cleaned_once(spark):
    """Articles, texts and keywords use the cleaned law name, and say what they said before."""
    row = ("d", "中华人民共和国刑法 ", "第五条", "总则", "", "刑法第二条和第三条，《中华人民共和国公司法》第九条", ["第七条", " 民法典第八条", "房东"])
    rows = spark.createDataFrame([row], "doc_id string, law_name string, article_no string, chapter string, effective_date string, text string, keywords array<string>")
    made = knowledge_base.clean_laws(rows)
    got = made.first()
    assert (got["article_no"], got["text"], got["keywords"]) == ("刑法第五条", "刑法第二条和刑法第三条，公司法第九条", ["刑法第七条", "民法典第八条", "出租人"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("coalesce(law_name#") == 1


def test_windows_of_a_long_text_cost_like_those_of_short_ones(spark):
    """A window is not counted off from the front of the whole text; every window against plain slices."""
    text = "".join(f" word{i % 97} é盗{i}\n" for i in range(1000))
    for size, overlap in ((400, 80), (7, 3), (5, 0)):
        expected = [(s, min(s + size, len(text)), text[s : s + size].strip()) for s in range(0, len(text), size - overlap)]
        rows = spark.createDataFrame([(text,), ("",), (None,), ("a",)], "t string").select(chunking.window_spans(F.col("t"), size, overlap).alias("w")).collect()
        assert [tuple(w) for w in rows[0]["w"]] == [w for w in expected if w[2]]
        assert rows[1]["w"] == [] and rows[2]["w"] == [] and [tuple(w) for w in rows[3]["w"]] == [(0, 1, "a")]
    def seconds(times, each):
        rows = spark.range(each).coalesce(1).select(F.repeat(F.concat(F.lit("some words, "), F.col("id").cast("string")), times).alias("t"))
        took = []
        for _ in range(3):
            began = time.perf_counter()
            rows.select(F.sum(F.size(chunking.window_spans(F.col("t"))))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(120_000, 1) < 8 * seconds(6_000, 20)
