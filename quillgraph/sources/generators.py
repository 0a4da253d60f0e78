"""Synthetic corpora built from ``spark.range`` and fixed pools."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The topic pools the corpora cycle through.
LAW_POOL = [
    ("中华人民共和国刑法", "分则", "盗窃罪"),
    ("中华人民共和国刑法", "分则", "诈骗罪"),
    ("中华人民共和国民法典", "合同编", "违约责任"),
    ("中华人民共和国民法典", "合同编", "租赁合同"),
    ("中华人民共和国民法典", "侵权责任编", "侵权责任"),
    ("中华人民共和国公司法", "公司设立和组织机构", "公司治理"),
    ("中华人民共和国劳动合同法", "劳动合同的履行和变更", "劳动争议"),
    ("最高人民法院关于审理买卖合同纠纷案件适用法律问题的解释", "总则", "买卖合同"),
    ("最高人民法院关于审理民间借贷案件适用法律若干问题的规定", "总则", "借贷纠纷"),
]
CASE_TYPES = ["盗窃案件", "合同违约案件", "租赁纠纷案件", "侵权责任案件", "公司纠纷案件", "劳动争议案件", "买卖合同案件", "民间借贷案件"]
COURTS = ["某市中级人民法院", "某区人民法院", "某省高级人民法院", "某铁路运输法院"]
FAQ_TOPICS = ["盗窃罪", "诈骗罪", "合同违约", "租赁纠纷", "侵权责任", "公司纠纷", "劳动争议", "买卖合同", "民间借贷"]


@dataclass(frozen=True)
class Sizes:
    """Rows per layer; the last ``*_copies`` rows repeat the first ones under a new id."""

    statutes: int = 240
    statute_copies: int = 20
    cases: int = 240
    case_copies: int = 20
    faqs: int = 80
    faq_copies: int = 10
    first_article: int = 501
    amount_base: int = 1000
    amount_step: int = 37


ROUND3 = Sizes()


def _pick(values: list[str], i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), ((i - 1) % len(values)).cast("int"))


def _base(spark: SparkSession, total: int, copies: int) -> DataFrame:
    """(ord, i): row number and the number its content is made from."""
    n = total - copies
    return spark.range(1, total + 1).select(
        F.col("id").alias("ord"), F.when(F.col("id") > n, F.col("id") - n).otherwise(F.col("id")).alias("i")
    )


def statutes(spark: SparkSession, sizes: Sizes = ROUND3) -> DataFrame:
    i = F.col("i")
    law, chapter, topic = (_pick([row[k] for row in LAW_POOL], i) for k in range(3))
    article = F.format_string("第%d条", i + sizes.first_article - 1)
    title = F.concat(law, article)
    content = F.concat(
        title, F.format_string(f"\n第%d页 共{sizes.statutes}页\n", i), law, F.lit("\n"), chapter, F.lit("\n"), article,
        F.lit("：针对"), topic, F.lit("争议，行为人应依法承担相应责任。\n本条样本编号"), i.cast("string"),
        F.lit("，人民法院应结合证据链完整性、损失结果与责任基础综合裁判。\n"), F.format_string("页码:%d\n", i),
    )
    return _base(spark, sizes.statutes, sizes.statute_copies).select(
        "ord", F.format_string("statute_%03d", "ord").alias("doc_id"), title.alias("title"), law.alias("law_name"),
        chapter.alias("chapter"), article.alias("article_no"), F.lit("statute").alias("source_type"), content.alias("content"),
    )


def cases(spark: SparkSession, sizes: Sizes = ROUND3) -> DataFrame:
    i = F.col("i")
    kind, court = _pick(CASE_TYPES, i), _pick(COURTS, i)
    title = F.concat(kind, F.format_string("摘要第%d号", i))
    focus = F.format_string("责任承担范围、证据证明力、法律适用顺序（样本%d）", i)
    judgment = F.format_string("支持有证据支持的诉请，对证据不足部分不予支持（样本%d）", i)
    content = F.concat(
        title, F.format_string("\n中国裁判文书网\n第%d页\n案情：张某与甲公司围绕", i), kind,
        F.format_string("发生争议，争议金额约%d元，李某、乙公司参与履行。\n争议焦点：", i * sizes.amount_step + sizes.amount_base),
        focus, F.lit("。\n法院认为："), court, F.lit("认为应结合合同履行、过错程度、损失结果与举证责任综合判断。\n裁判结果："),
        judgment, F.format_string("。\n页码:%d\n", i),
    )
    return _base(spark, sizes.cases, sizes.case_copies).select(
        "ord", F.format_string("case_%03d", "ord").alias("doc_id"), F.format_string("（2025）示例案字第%04d号", i).alias("case_id"),
        title.alias("title"), court.alias("court"), kind.alias("case_type"), focus.alias("dispute_focus"),
        judgment.alias("judgment"), F.lit("case").alias("source_type"), content.alias("content"),
    )


def faqs(spark: SparkSession, sizes: Sizes = ROUND3) -> DataFrame:
    i = F.col("i")
    topic = _pick(FAQ_TOPICS, i)
    return _base(spark, sizes.faqs, sizes.faq_copies).select(
        "ord", F.format_string("faq_%03d", "ord").alias("faq_id"),
        F.concat(topic, F.format_string("中，当事人应如何依法主张权利？第%d问", i)).alias("question"),
        F.format_string("通常应先固定证据（样本%d），再依据相关法条主张请求权基础；协商不成时可诉讼或仲裁。", i).alias("answer"),
        topic.alias("topic"), F.lit("faq").alias("source_type"),
    )
