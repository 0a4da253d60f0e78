"""Ordered first-match rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions import fixed_values as fv
from quillgraph.functions import text as tx


def document_type(source_type: Column, doc_id: Column, title: Column, text: Column) -> Column:
    """law, case, faq or generic: by source type, then ids, then content."""
    kind = F.lower(tx.text_or_empty(source_type))
    doc_id, title, text = F.lower(tx.text_or_empty(doc_id)), F.lower(tx.text_or_empty(title)), tx.text_or_empty(text)
    return (
        F.when(kind.isin(fv.LAW_SOURCE_TYPES), "law")
        .when(kind.isin(fv.CASE_SOURCE_TYPES), "case")
        .when(kind.isin(fv.FAQ_SOURCE_TYPES), "faq")
        .when(doc_id.contains("law") | title.contains("law") | (text.contains("第") & text.contains("条")), "law")
        .when(
            doc_id.contains("case") | title.contains("case") | tx.contains_any(text, fv.CASE_CONTENT_WORDS),
            "case",
        )
        .otherwise("generic")
    )


def chunk_law_name(law_name: Column, text: Column) -> Column:
    given = tx.text_or_empty(law_name)
    return F.when(given != "", given).otherwise(tx.first_value(text, fv.CHUNK_LAW_WORDS, ""))


def structure_statute(title: Column, content: Column, law_name: Column, article_no: Column, chapter: Column) -> dict:
    """Fill law, chapter and article where the row does not give them."""
    title, law, article, part = (tx.strip(tx.text_or_empty(c)) for c in (title, law_name, article_no, chapter))
    found_law = F.coalesce(
        *[F.when(title.contains(n) | content.contains(n), F.lit(n)) for n in fv.LAW_NAME_CANDIDATES], F.lit("")
    )
    in_title = F.regexp_extract(title, fv.ARTICLE_PATTERN, 0)
    in_content = F.regexp_extract(content, fv.ARTICLE_PATTERN, 0)
    return {
        "law_name": F.when(law != "", law).otherwise(found_law),
        "chapter": F.when(part != "", part).otherwise(F.regexp_extract(content, fv.CHAPTER_PATTERN, 0)),
        "article_no": F.when(article != "", article).when(in_title != "", in_title).otherwise(in_content),
    }


def structure_case(
    doc_id: Column, content: Column, case_id: Column, court: Column, case_type: Column,
    dispute_focus: Column, judgment: Column,
) -> dict:
    """Fill case fields from the cleaned content where missing."""
    doc_id, case_id, court, case_type, dispute_focus, judgment = (
        tx.strip(tx.text_or_empty(c)) for c in (doc_id, case_id, court, case_type, dispute_focus, judgment)
    )
    inferred_type = tx.first_value(content, [(w, w + fv.CASE_TYPE_SUFFIX) for w in fv.CASE_TYPE_WORDS], "")

    def filled(given: Column, found: Column) -> Column:
        return F.when(given != "", given).otherwise(found)

    return {
        "case_id": filled(case_id, doc_id),
        "court": filled(court, tx.first_match(content, fv.COURT_PATTERN)),
        "case_type": filled(case_type, inferred_type),
        "dispute_focus": filled(dispute_focus, tx.strip(tx.first_match(content, fv.DISPUTE_PATTERN))),
        "judgment": filled(judgment, tx.strip(tx.first_match(content, fv.JUDGMENT_PATTERN))),
    }


def structure_faq(topic: Column, question: Column) -> dict:
    given = tx.strip(tx.text_or_empty(topic))
    found = tx.first_value(tx.text_or_empty(question), [(w, w) for w in fv.FAQ_TOPIC_WORDS], fv.FAQ_DEFAULT_TOPIC)
    return {"topic": F.when(given != "", given).otherwise(found)}


def question_type(query: Column) -> Column:
    q = tx.strip(tx.text_or_empty(query))
    choices = [
        F.when(tx.contains_any(q, any_of) & ~tx.contains_any(q, none_of), F.lit(result))
        for any_of, none_of, result in fv.QUESTION_TYPE_RULES
    ]
    return F.coalesce(*choices, F.lit("unknown"))


def retrieval_strategy(query: Column, kind: Column | None = None) -> Column:
    """struct(retrieval_strategy, reason, uncertain) of the first matching rule.

    ``kind`` is the question type where it is known already.
    """
    q = tx.strip(tx.text_or_empty(query))
    kind = question_type(query) if kind is None else kind
    choices = []
    for any_of, also, none_of, wanted_type, strategy, reason in fv.STRATEGY_RULES:
        if wanted_type is not None:
            condition = kind == wanted_type
        else:
            # English triggers ignore case, Chinese ones have none.
            condition = tx.contains_any(F.lower(q), [w for w in any_of if w.isascii()]) | tx.contains_any(
                q, [w for w in any_of if not w.isascii()]
            )
        if also:
            condition = condition & tx.contains_any(q, also)
        if none_of:
            condition = condition & ~tx.contains_any(q, none_of)
        choices.append(F.when(condition, _strategy(strategy, reason, False)))
    return F.coalesce(*choices, _strategy(*fv.STRATEGY_DEFAULT, True))


def _strategy(strategy: str, reason: str, uncertain: bool) -> Column:
    return F.struct(
        F.lit(strategy).alias("retrieval_strategy"),
        F.lit(reason).alias("reason"),
        F.lit(uncertain).alias("uncertain"),
    )


def route(strategy: Column) -> Column:
    """struct(route, preferred_tools) of a retrieval strategy."""

    def entry(name: str) -> Column:
        route_name, tools = fv.ROUTES[name]
        tool_array = F.array(*[F.lit(t) for t in tools]) if tools else F.array().cast("array<string>")
        return F.struct(F.lit(route_name).alias("route"), tool_array.alias("preferred_tools"))

    return (
        F.when(strategy == "vector", entry("vector"))
        .when(strategy == "hybrid", entry("hybrid"))
        .when(strategy == "direct_answer", entry("direct_answer"))
        .otherwise(entry("graph"))
    )


def topic(query: Column) -> Column:
    return tx.first_value(tx.text_or_empty(query), fv.TOPIC_HINTS, fv.TOPIC_OTHER)


def source_type(given: Column, evidence_type: Column) -> Column:
    kind = F.lower(tx.text_or_empty(given))
    return (
        F.when(kind.isin(fv.LAW_SOURCE_TYPES), "statute")
        .when(kind.isin(fv.CASE_SOURCE_TYPES), "case")
        .when(kind.isin(fv.FAQ_SOURCE_TYPES), "faq")
        .when(evidence_type == "graph", "graph")
        .when(evidence_type == "vector", "vector")
        .when(kind != "", kind)
        .otherwise("unknown")
    )


def status(value: Column) -> Column:
    cleaned = F.lower(tx.strip(F.when(tx.text_or_empty(value) == "", "open").otherwise(value)))
    return F.when(cleaned.isin(list(fv.STATUS_WEIGHT)), cleaned).otherwise("open")


def failure_reason_key(value: Column) -> Column:
    cleaned = F.replace(F.lower(tx.strip(tx.text_or_empty(value))), F.lit(" "), F.lit("_"))
    return F.when(cleaned == "", "unknown").otherwise(cleaned)


def lookup(key: Column, table: dict, default) -> Column:
    """Constant map look-up with a default, as one CASE expression."""
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def lenient_bool(value: Column, default: bool) -> Column:
    v = F.lower(tx.strip(value.cast("string")))
    return (
        F.when(v.isin("true", "1", "yes", "y"), True).when(v.isin("false", "0", "no", "n"), False).otherwise(default)
    )


def lenient_double(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))
