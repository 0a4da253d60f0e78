"""Queries over scans, cleaning, tokens and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import fixed_values as fv
from quillgraph.functions import ids, rules
from quillgraph.functions import text as tx
from quillgraph.operators import chunking
from quillgraph.registry.common import (
    ARTICLE, CASES_SQL, NUM, QUESTIONS_SQL, STATUTES_SQL, cases, documents, questions, registry, sql_clean, sql_clean_join,
    sql_contains_any, sql_first_value, sql_key, sql_ordered_distinct, sql_sentences, sql_strip, sql_text,
    sql_tokens_estimate, sql_words, statutes, table,
)
from quillgraph.session import compute_once

QUERIES, SQL, query = registry()


@query("scan_projection", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def scan_projection(spark, sf):
    return table(spark, sf, "documents").filter("lang = 'en' AND n_chars > 500").select("doc_id", "source", "n_chars")


@query("text_normalize", f"SELECT doc_id, md5({sql_key('text')}) AS key FROM documents")
def text_normalize(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.normalize_key(F.col("text"))).alias("key"))


@query(
    "text_clean_statutes",
    f"""WITH {STATUTES_SQL}, c AS (SELECT doc_id, {sql_clean('content', 'title')} AS lines FROM statutes)
    SELECT doc_id, md5({sql_clean_join('lines')}) AS content, length({sql_clean_join('lines')}) AS n FROM c""",
)
def text_clean_statutes(spark, sf):
    rows = compute_once(statutes(spark, sf), clean=tx.clean_document_text(F.col("content"), F.col("title")))
    return rows.select("doc_id", F.md5("clean").alias("content"), F.length("clean").alias("n"))


@query(
    "text_clean_documents",
    f"""WITH c AS (SELECT doc_id, {sql_clean('text')} AS lines FROM documents)
    SELECT doc_id, md5({sql_clean_join('lines')}) AS content FROM c""",
)
def text_clean_documents(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.clean_document_text(F.col("text"))).alias("content"))


def _kb_sql(x):
    out = f"translate(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '　' || chr(65533), ' ')"
    out = f"array_to_string(list_filter(list_transform(string_split({out}, chr(10)), lambda l: {sql_strip('l')}), lambda l: l <> ''), chr(10))"
    for mark in "，。；：！？":
        out = f"regexp_replace({out}, '{mark}+', '{mark}', 'g')"
    for mark in r",.!?;:":
        out = f"regexp_replace({out}, '[{mark}]+', '{mark}', 'g')"
    return sql_strip(f"regexp_replace({out}, '[ \\t]{{2,}}', ' ', 'g')")


@query("text_clean_light", f"SELECT page_id, md5({_kb_sql('html')}) AS content FROM pages")
def text_clean_light(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.clean_text(F.col("html"))).alias("content"))


_ADJ = "list_filter(ls, lambda l, i: CASE WHEN i = 1 THEN l <> '' ELSE l <> ls[i - 1] END)"


@query(
    "adjacent_line_dedup",
    f"WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id, len({_ADJ}) AS kept, md5(array_to_string({_ADJ}, chr(10))) AS content FROM d",
)
def adjacent_line_dedup(spark, sf):
    rows = compute_once(documents(spark, sf), lines=F.split("text", "\n"))
    rows = compute_once(rows, kept=tx.drop_adjacent_repeats(F.col("lines")))
    return rows.select("doc_id", F.size("kept").alias("kept"), F.md5(F.array_join("kept", "\n")).alias("content"))


@query(
    "sentence_split",
    f"WITH d AS (SELECT doc_id, {sql_sentences('text')} AS s FROM documents) SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS content FROM d",
)
def sentence_split(spark, sf):
    rows = compute_once(documents(spark, sf), s=tx.sentences(F.col("text")))
    return rows.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("content"))


_BIGRAMS = (
    f"list_transform({sql_words('query')}, lambda w: CASE WHEN length(w) > 2 AND regexp_matches(w, '[\\x{{4e00}}-\\x{{9fff}}]')"
    " THEN list_concat([w], list_transform(range(1, length(w)), lambda i: substr(w, CAST(i AS INTEGER), 2))) ELSE [w] END)"
)


@query(
    "tokenize_questions",
    f"WITH {QUESTIONS_SQL}, t AS (SELECT qid, flatten({_BIGRAMS}) AS t FROM questions) SELECT qid, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM t",
)
def tokenize_questions(spark, sf):
    rows = compute_once(questions(spark, sf), t=tx.search_tokens(F.col("query")))
    return rows.select("qid", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(
    "tokenize_documents",
    f"WITH t AS (SELECT doc_id, {sql_words('text')} AS t FROM documents) SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct FROM t",
)
def tokenize_documents(spark, sf):
    rows = compute_once(documents(spark, sf), t=tx.search_tokens(F.col("text")))
    return rows.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(
    "fallback_terms",
    f"""WITH {QUESTIONS_SQL} SELECT qid, array_to_string(list_concat(regexp_extract_all(query, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'),
    list_filter({sql_words('query')}, lambda w: length(w) > 1)), ' ') AS terms FROM questions""",
)
def fallback_terms(spark, sf):
    return questions(spark, sf).select("qid", F.array_join(tx.fallback_terms(F.col("query")), " ").alias("terms"))


@query("token_estimate", f"SELECT conv_id, turn, {sql_tokens_estimate('text')}::BIGINT AS tokens FROM conversations")
def token_estimate(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "claim_split",
    f"""WITH c AS (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[。！？!?；;]|以及|并且|且|同时'), lambda s: {sql_strip('s')}), lambda s: s <> '')[1:4] AS c FROM benchmark)
    SELECT item_id, len(c) AS n, array_to_string(c, '|') AS claims FROM c""",
)
def claim_split(spark, sf):
    rows = compute_once(table(spark, sf, "benchmark"), c=tx.claims(F.col("text")))
    return rows.select("item_id", F.size("c").alias("n"), F.array_join("c", "|").alias("claims"))


_WIN = f"list_filter(list_transform(range(0, length(text), 320), lambda s: {{'a': s, 'b': least(s + 400, length(text)), 't': {sql_strip('substr(text, CAST(s + 1 AS INTEGER), 400)')}}}), lambda p: p.t <> '')"


@query(
    "chunk_windows",
    f"""WITH w AS (SELECT doc_id, unnest({_WIN}) AS p FROM documents)
    SELECT doc_id, CAST(p.a AS BIGINT) AS start_char, CAST(p.b AS BIGINT) AS end_char, md5(p.t) AS text FROM w""",
)
def chunk_windows(spark, sf):
    rows = compute_once(documents(spark, sf), p=chunking.window_spans(F.col("text")))
    return rows.select("doc_id", F.explode("p").alias("p")).select("doc_id", "p.start_char", "p.end_char", F.md5("p.text").alias("text"))


_HEADERS = "案情|争议焦点|法院认为|本院认为|裁判理由|裁判结果|裁判要旨|判决结果|审理查明"


@query(
    "chunk_case_sections",
    f"""WITH {CASES_SQL}, c AS (SELECT doc_id, {sql_clean('content')} AS lines FROM cases),
    t AS (SELECT doc_id, {sql_clean_join('lines')} AS text FROM c),
    m AS (SELECT doc_id, text, string_split(regexp_replace(text, '({_HEADERS})', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM t),
    p AS (SELECT doc_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS k FROM m),
    o AS (SELECT doc_id, k, raw, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM p WHERE raw <> '')
    SELECT doc_id, CASE WHEN regexp_extract(raw, '^(?:{_HEADERS})') = '' THEN '案情' ELSE regexp_extract(raw, '^(?:{_HEADERS})') END AS section,
      CAST(e - length(raw) AS BIGINT) AS start_char, CAST(e AS BIGINT) AS end_char, md5({sql_strip('raw')}) AS text
    FROM o WHERE {sql_strip('raw')} <> ''""",
)
def chunk_case_sections(spark, sf):
    docs = cases(spark, sf).select("doc_id", "title", F.col("content").alias("text"), F.lit("case").alias("source_type"))
    return chunking.chunk_documents(docs).select("doc_id", "section", "start_char", "end_char", F.md5("text").alias("text"))


_HEAD = f"第{NUM}+(?:条|款|项)"


@query(
    "chunk_law_articles",
    f"""WITH {STATUTES_SQL}, c AS (SELECT doc_id, law_name, {sql_clean('content')} AS lines FROM statutes),
    t AS (SELECT doc_id, law_name, {sql_clean_join('lines')} AS text FROM c),
    n AS (SELECT doc_id, text, CASE WHEN law_name <> '' THEN law_name ELSE {sql_first_value('text', fv.CHUNK_LAW_WORDS.items(), "''")} END AS law FROM t),
    m AS (SELECT doc_id, law, string_split(regexp_replace(text, '({_HEAD})', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM n),
    p AS (SELECT doc_id, law, unnest(ps) AS raw, generate_subscripts(ps, 1) AS k FROM m),
    o AS (SELECT doc_id, law, k, raw, regexp_extract(raw, '^{_HEAD}') AS head, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM p WHERE raw <> ''),
    f AS (SELECT *, last_value(CASE WHEN suffix(head, '条') THEN head END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS art FROM o)
    SELECT doc_id, head AS section, {sql_first_value('law', [(n, n) for n in fv.ARTICLE_LAWS], "''")} || coalesce(art, head) AS article_no,
      CAST(e - length(raw) AS BIGINT) AS start_char, CAST(e AS BIGINT) AS end_char, md5({sql_strip('raw')}) AS text
    FROM f WHERE head <> ''""",
)
def chunk_law_articles(spark, sf):
    docs = statutes(spark, sf).select(
        "doc_id", "title", F.col("content").alias("text"), "law_name", F.lit("statute").alias("source_type")
    )
    return chunking.chunk_documents(docs).select(
        "doc_id", "section", "article_no", "start_char", "end_char", F.md5("text").alias("text")
    )


@query(
    "chunk_type_counts",
    f"""WITH c AS (SELECT doc_id, source, {sql_clean('text')} AS lines FROM documents),
    t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'faq' ELSE '' END AS st, {sql_clean_join('lines')} AS text FROM c),
    w AS (SELECT st, unnest({_WIN}) AS p FROM t)
    SELECT CASE WHEN st = 'faq' THEN 'faq' ELSE 'generic' END AS doc_type, count(*) AS n FROM w GROUP BY 1""",
)
def chunk_type_counts(spark, sf):
    docs = documents(spark, sf).select(
        "doc_id", F.col("source").alias("title"), "text", F.when(F.col("doc_id") % 3 == 0, "faq").otherwise("").alias("source_type")
    )
    return chunking.chunk_documents(docs).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "document_type",
    f"""WITH {QUESTIONS_SQL} SELECT qid, CASE
      WHEN contains(query, '第') AND contains(query, '条') THEN 'law'
      WHEN {sql_contains_any('query', fv.CASE_CONTENT_WORDS)} THEN 'case' ELSE 'generic' END AS doc_type FROM questions""",
)
def document_type(spark, sf):
    empty = F.lit("")
    return questions(spark, sf).select("qid", rules.document_type(empty, empty, empty, F.col("query")).alias("doc_type"))


@query(
    "evidence_ids",
    "SELECT doc_id, substr(md5(concat_ws('|', source, doc_id::VARCHAR, '', 'doc::' || doc_id::VARCHAR, lang, 'HYBRID_MATCH', substr(text, 1, 160))), 1, 16) AS evidence_id FROM documents",
)
def evidence_ids(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        ids.evidence_id(
            F.col("source"), F.col("doc_id"), F.lit(""), F.concat(F.lit("doc::"), F.col("doc_id").cast("string")),
            F.col("lang"), F.lit("HYBRID_MATCH"), F.col("text"),
        ).alias("evidence_id"),
    )


@query(
    "cache_keys",
    """SELECT item_id, sha256(text) AS text_key, sha1('local' || chr(10) || 'rules' || chr(10) || text) AS triple_key FROM benchmark""",
)
def cache_keys(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id", F.sha2("text", 256).alias("text_key"),
        ids.triple_cache_key(F.lit("local"), F.lit("rules"), F.col("text")).alias("triple_key"),
    )


@query(
    "article_names",
    f"""WITH {STATUTES_SQL}, a AS (SELECT doc_id, law_name, replace(replace(replace(title, '《', ''), '》', ''), '中华人民共和国', '') AS a FROM statutes)
    SELECT doc_id, CASE WHEN regexp_extract(a, '{ARTICLE}') = '' THEN a
      ELSE {sql_first_value('a', [(n, n) for n in fv.ARTICLE_LAWS], "''")} || regexp_extract(a, '{ARTICLE}') END AS article FROM a""",
)
def article_names(spark, sf):
    return statutes(spark, sf).select("doc_id", tx.normalize_article_name(F.col("title")).alias("article"))


_D = "('零一二三四五六七八九')"


@query(
    "chinese_numerals",
    f"""WITH n AS (SELECT doc_id, doc_id % 10000 AS n, lpad((doc_id % 10000)::VARCHAR, 4, '0') AS s FROM documents),
    z AS (SELECT doc_id, n, array_to_string(list_transform([1, 2, 3, 4], lambda i: CASE WHEN substr(s, i, 1) = '0' THEN '零'
      ELSE substr({_D}, CAST(substr(s, i, 1) AS INTEGER) + 1, 1) || (['千', '百', '十', ''])[i] END), '') AS z FROM n)
    SELECT doc_id, CASE WHEN n <= 0 THEN '零' ELSE replace(regexp_replace(regexp_replace(z, '零+', '零', 'g'), '^零|零$', '', 'g'), '一十', '十') END AS numeral FROM z""",
)
def chinese_numerals(spark, sf):
    return documents(spark, sf).select("doc_id", tx.chinese_numeral(F.col("doc_id") % 10000).alias("numeral"))


@query(
    "char_jaccard",
    f"""WITH {STATUTES_SQL}, s AS (SELECT doc_id, list_distinct(string_split({sql_key('title')}, '')) AS a, list_distinct(string_split({sql_key('content')}, '')) AS b FROM statutes)
    SELECT doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 8) AS jaccard FROM s""",
)
def char_jaccard(spark, sf):
    rows = statutes(spark, sf).select(
        "doc_id", tx.normalize_key(F.col("title")).alias("a"), tx.normalize_key(F.col("content")).alias("b")
    )
    return compute_once(rows, a=tx.char_set(F.col("a")), b=tx.char_set(F.col("b"))).select(
        "doc_id", F.round(tx.set_jaccard(F.col("a"), F.col("b")), 8).alias("jaccard")
    )
