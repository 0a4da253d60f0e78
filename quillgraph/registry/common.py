"""Table access, derived rows and SQL fragments shared by the query registry.

The driver tables hold no Chinese text, so rules for it run on rows Spark
derives from those tables: every derived row wraps one whole table row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def registry():
    """(queries, oracle SQL, decorator) of one registry module.

    Integer columns leave as bigint, the type DuckDB counts in.
    """
    queries: dict = {}
    oracle: dict = {}

    def query(name, sql=None):
        def register(fn):
            def run(spark: SparkSession, sf: str) -> DataFrame:
                df = fn(spark, sf)
                return df.select(
                    *[F.col(n).cast("bigint").alias(n) if t in ("int", "smallint") else F.col(n) for n, t in df.dtypes]
                )

            run.__name__ = run.__qualname__ = name
            run.__doc__ = fn.__doc__
            queries[name] = run
            if sql:
                oracle[name] = sql
            return fn

        return register

    return queries, oracle, query


# --- derived rows ---------------------------------------------------------------
CASE_TYPES = ["盗窃案件", "合同违约案件", "租赁纠纷案件", "侵权责任案件", "公司纠纷案件", "劳动争议案件"]
COURTS = ["某市中级人民法院", "某区人民法院", "某省高级人民法院"]
LAWS = [
    "中华人民共和国刑法",
    "中华人民共和国民法典",
    "中华人民共和国公司法",
    "中华人民共和国劳动合同法",
    "中华人民共和国民法典",
]
CHAPTERS = ["分则", "第二编", "总则", "第三章", "合同编"]
QUESTION_STEMS = [
    "盗窃行为通常适用哪一条法律条文？",
    "违约责任是什么含义？",
    "王某的行为如何定性？",
    "出租人可以主张继续履行和赔偿损失吗？",
    "那如果对方不付租金呢",
    "你好，你是谁",
    "法院如何认定侵权责任？刑法第二百六十四条",
    "合同违约后，主要债务未履行以及违约金如何承担",
    "未登记的房子物权变动了吗",
    "这个怎么办",
    "2024年3月5日房东收取租金3000元，张某违约",
    "劳动者与用人单位的劳动争议，甲公司欠薪2.5万元",
]
TOPIC_NAMES = ["盗窃罪", "违约责任", "租赁合同", ""]


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_pick(values: list[str], index: str) -> str:
    return f"({sql_list(values)})[CAST(1 + ({index}) % {len(values)} AS INTEGER)]"


def statutes(spark: SparkSession, sf: str) -> DataFrame:
    """Raw statute rows: one per document, some fields left blank."""
    i = F.col("doc_id")
    article = F.concat(F.lit("第"), (500 + i % 700).cast("string"), F.lit("条"))
    law = pick(LAWS, i)
    title = F.concat(law, article)
    return documents(spark, sf).select(
        i.alias("ord"),
        F.concat(F.lit("statute_"), i.cast("string")).alias("doc_id"),
        title.alias("title"),
        F.when(i % 3 == 0, "").otherwise(law).alias("law_name"),
        F.when(i % 5 == 0, "").otherwise(pick(CHAPTERS, i)).alias("chapter"),
        F.when(i % 4 == 0, "").otherwise(article).alias("article_no"),
        F.concat(
            title, F.lit("\n第"), i.cast("string"), F.lit("页 共9页\n"), law, F.lit("\n【"), pick(CHAPTERS, i), F.lit("】\n"),
            article, F.lit("：行为人应依法承担违约责任,,。\n第一款："), F.col("text"), F.lit("\n第二项：构成盗窃罪的，依刑法第二百六十四条。\n本页无正文\n页码:"),
            i.cast("string"), F.lit("\n"),
        ).alias("content"),
    )


STATUTES_SQL = f"""
statutes_base AS (
  SELECT doc_id AS i, text, '第' || (500 + doc_id % 700)::VARCHAR || '条' AS art,
         {sql_pick(LAWS, 'doc_id')} AS law, {sql_pick(CHAPTERS, 'doc_id')} AS chap
  FROM documents),
statutes AS (
  SELECT i AS ord, 'statute_' || i::VARCHAR AS doc_id, law || art AS title,
         CASE WHEN i % 3 = 0 THEN '' ELSE law END AS law_name,
         CASE WHEN i % 5 = 0 THEN '' ELSE chap END AS chapter,
         CASE WHEN i % 4 = 0 THEN '' ELSE art END AS article_no,
         law || art || chr(10) || '第' || i::VARCHAR || '页 共9页' || chr(10) || law || chr(10) || '【' || chap || '】' || chr(10)
           || art || '：行为人应依法承担违约责任,,。' || chr(10) || '第一款：' || text || chr(10)
           || '第二项：构成盗窃罪的，依刑法第二百六十四条。' || chr(10) || '本页无正文' || chr(10) || '页码:' || i::VARCHAR || chr(10) AS content
  FROM statutes_base)
"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Raw case rows: one per document, structured fields to be inferred."""
    i = F.col("doc_id")
    kind, court = pick(CASE_TYPES, i), pick(COURTS, i)
    title = F.concat(kind, F.lit("摘要第"), i.cast("string"), F.lit("号"))
    return documents(spark, sf).select(
        i.alias("ord"),
        F.concat(F.lit("case_"), i.cast("string")).alias("doc_id"),
        title.alias("title"),
        F.concat(
            title, F.lit("\n中国裁判文书网"), i.cast("string"), F.lit("\n第"), i.cast("string"), F.lit("页\n案情：张某与甲公司围绕"), kind,
            F.lit("发生争议，"), F.col("text"), F.lit("\n争议焦点：责任承担范围与违约责任。\n法院认为："), court,
            F.lit("认为构成侵权责任，应依据民法典第五百七十七条综合判断。\n裁判结果：支持诉请。Acme Corp 应于 Jan 3, 2024 前履行 Section 12。\n页码:"),
            i.cast("string"), F.lit("\n"),
        ).alias("content"),
    )


CASES_SQL = f"""
cases AS (
  SELECT doc_id AS ord, 'case_' || doc_id::VARCHAR AS doc_id,
         {sql_pick(CASE_TYPES, 'doc_id')} || '摘要第' || doc_id::VARCHAR || '号' AS title,
         {sql_pick(CASE_TYPES, 'doc_id')} || '摘要第' || doc_id::VARCHAR || '号' || chr(10) || '中国裁判文书网' || doc_id::VARCHAR || chr(10)
           || '第' || doc_id::VARCHAR || '页' || chr(10) || '案情：张某与甲公司围绕' || {sql_pick(CASE_TYPES, 'doc_id')} || '发生争议，' || text
           || chr(10) || '争议焦点：责任承担范围与违约责任。' || chr(10) || '法院认为：' || {sql_pick(COURTS, 'doc_id')}
           || '认为构成侵权责任，应依据民法典第五百七十七条综合判断。' || chr(10)
           || '裁判结果：支持诉请。Acme Corp 应于 Jan 3, 2024 前履行 Section 12。' || chr(10) || '页码:' || doc_id::VARCHAR || chr(10) AS content
  FROM documents)
"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per user message: a stem chosen by position, then the message.

    Every fourth conversation asks each stem again on its own, later, so that short questions occur.
    """
    n = F.col("conv_id") * 5 + F.col("turn") / 2
    stem = pick(QUESTION_STEMS, F.floor(n))
    said = spread(table(spark, sf, "conversations")).filter(F.col("role") == "user").select(
        "conv_id", "turn", stem.alias("stem"), "text"
    )
    whole = said.select("conv_id", "turn", F.concat("stem", F.lit(" "), "text").alias("query"), "text")
    short = said.filter(F.col("conv_id") % 4 == 3).select("conv_id", (F.col("turn") + 1000).alias("turn"), F.col("stem").alias("query"), "text")
    return whole.unionByName(short).select("conv_id", "turn", (F.col("conv_id") * 10000 + F.col("turn")).alias("qid"), "query", "text")


_N = "CAST(floor(conv_id * 5 + turn / 2) AS BIGINT)"
QUESTIONS_SQL = f"""
questions AS (
  SELECT conv_id, turn, conv_id * 10000 + turn AS qid, {sql_pick(QUESTION_STEMS, _N)} || ' ' || text AS query, text
  FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT conv_id, turn + 1000, conv_id * 10000 + turn + 1000, {sql_pick(QUESTION_STEMS, _N)}, text
  FROM conversations WHERE role = 'user' AND conv_id % 4 = 3)
"""


# --- SQL fragments -----------------------------------------------------------------
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NUM = "[一二三四五六七八九十百千万零两〇0-9]"
ARTICLE = f"第{NUM}+条"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def sql_key(x: str) -> str:
    return f"translate(regexp_replace(lower({x}), '{WS}+', '', 'g'), '，。；：！？,.!?、（）()-', '')"


def sql_contains_any(x: str, words: list[str]) -> str:
    if not words:
        return "FALSE"
    return "(" + " OR ".join(f"contains({x}, {sql_text(w)})" for w in words) + ")"


def sql_ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def sql_sentences(x: str) -> str:
    pieces = f"regexp_extract_all({x}, '(?s)[^.!?。！？；;]*[.!?。！？；;]|[^.!?。！？；;]+$')"
    return f"list_filter(list_transform({pieces}, lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_clean(content: str, title: str | None = None) -> str:
    """clean_document_text as one SQL expression."""
    out = f"regexp_replace({content}, '\\r\\n?|\\f', chr(10), 'g')"
    out = f"translate({out}, ',;:?!()　' || chr(9) || chr(65533), '，；：？！（）  ')"
    lines = f"list_transform(string_split({out}, chr(10)), lambda l: {sql_collapse('l')})"
    noise = (
        r"regexp_matches(l, '(?i)^第\s*\d+\s*页\s*(共\s*\d+\s*页)?$|^页码[:：]?\s*\d+$|^page\s*\d+(\s*/\s*\d+)?$')"
        " OR regexp_matches(l, '^中华人民共和国.+$|^最高人民法院.+$|^中国裁判文书网.+$|^（?以下称.+）?$')"
    )
    keep = f"l <> '' AND NOT ({noise}) AND l NOT IN ('本页无正文', '以下无正文', '特此公告', '以上事实，有证据在卷佐证。')"
    if title:
        keep += f" AND ({sql_collapse(title)} = '' OR l <> {sql_collapse(title)})"
    return f"list_filter({lines}, lambda l: {keep})"


def sql_clean_join(lines: str) -> str:
    """Ordered distinct lines joined, punctuation runs collapsed."""
    out = f"array_to_string({sql_ordered_distinct(lines)}, chr(10))"
    for mark in "，。；：！？":
        out = f"regexp_replace({out}, '{mark}+', '{mark}', 'g')"
    return sql_strip(f"regexp_replace({out}, ' {{2,}}', ' ', 'g')")


def sql_first_value(x: str, entries, default: str) -> str:
    whens = " ".join(f"WHEN contains({x}, {sql_text(k)}) THEN {sql_text(v)}" for k, v in entries)
    return f"CASE {whens} ELSE {default} END"


def sql_bucket(token: str) -> str:
    return (
        f"CAST((('0x' || substr(md5({token}), 1, 16))::UBIGINT::HUGEINT * 256"
        f" + ('0x' || substr(md5({token}), 17, 16))::UBIGINT::HUGEINT) % 384 AS INTEGER)"
    )


def sql_tokens_estimate(x: str) -> str:
    return f"CAST(CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, floor(length({x}) * 0.6)) END AS INTEGER)"
