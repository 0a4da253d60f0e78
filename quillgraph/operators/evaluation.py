"""Evaluation metrics and reports over one row per question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import fixed_values as fv
from quillgraph.functions import text as tx


# --- per-question metrics -----------------------------------------------------------
def _norm(c: Column) -> Column:
    return tx.strip(F.lower(c))


def _share(expected: Column, hit) -> Column:
    n = F.size(expected)
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.size(F.filter(expected, hit)) / n)


def entity_hit_rate(expected: Column, linked: Column) -> Column:
    """Share of expected entities contained in some linked entity."""
    return _share(expected, lambda e: F.exists(linked, lambda x: F.contains(_norm(x), _norm(e))))


def evidence_path_hit_rate(expected: Column, haystack: Column) -> Column:
    """Share of expected evidence contained in names, mentions or edges."""
    return entity_hit_rate(expected, haystack)


def keyword_match_rate(expected: Column, answer: Column) -> Column:
    return _share(expected, lambda k: F.contains(_norm(answer), _norm(k)))


def citation_correctness(cited: Column, evidence_ids: Column) -> Column:
    """Share of cited ids that are evidence ids; 0 without citations or evidence."""
    n = F.size(cited)
    hits = F.size(F.filter(cited, lambda c: (c != "") & F.array_contains(evidence_ids, c)))
    return F.when((n <= 0) | (F.size(evidence_ids) <= 0), F.lit(0.0)).otherwise(hits / n)


def citation_coverage(claims: Column, citations: Column, grounded: Column) -> Column:
    """Share of claims with a cited supporting id, or words found in a citation.

    ``claims``: array<struct<claim, ids>>; ``citations``: array<struct<id, blob>>.
    """
    cited = F.array_distinct(F.filter(F.transform(citations, lambda c: c["id"]), lambda i: i != ""))
    grounded_ids = F.array_distinct(F.filter(F.coalesce(grounded, F.array().cast("array<string>")), lambda i: i != ""))
    without_claims = F.when(F.size(F.coalesce(grounded, F.array().cast("array<string>"))) > 0, tx.coverage(grounded_ids, cited)).otherwise(
        F.lit(1.0)
    )
    covered = F.filter(
        claims,
        lambda c: F.arrays_overlap(F.filter(c["ids"], lambda i: i != ""), cited)
        | F.exists(
            F.filter(F.split(_norm(c["claim"]), "(?U)\\s+"), lambda t: t != ""),
            lambda t: F.exists(citations, lambda x: F.contains(_norm(x["blob"]), t)),
        ),
    )
    return (
        F.when(F.size(claims) <= 0, without_claims)
        .when(F.size(cited) == 0, F.lit(0.0))
        .otherwise(F.size(covered) / F.size(claims))
    )


def multiturn_metrics(required: Column, expected: Column, query: Column, rewritten: Column, answer: Column, triggered: Column, similarity: Column) -> Column:
    """struct of the three rewrite metrics; zeros for single-turn questions."""
    n = F.greatest(F.lit(1), F.size(expected))
    in_query = F.size(F.filter(expected, lambda e: (e != "") & F.contains(rewritten, e)))
    in_answer = F.size(F.filter(expected, lambda e: (e != "") & F.contains(answer, e)))
    zero = F.lit(0.0)
    return F.struct(
        F.when(required, F.greatest(in_query, in_answer) / n).otherwise(zero).alias("context_resolution_accuracy"),
        F.when(required & triggered, F.lit(1.0)).otherwise(zero).alias("rewrite_trigger_accuracy"),
        F.when(required, 0.7 * (in_query / n) + 0.3 * similarity).otherwise(zero).alias("rewritten_query_quality"),
    )


# --- aggregates -----------------------------------------------------------------------
def _means(results: DataFrame) -> list[Column]:
    present = [
        F.coalesce(F.avg(F.coalesce(F.col(source), F.lit(0.0))), F.lit(0.0)).alias(name)
        for name, source in fv.METRICS.items()
        if source in results.columns
    ]
    return [F.count(F.lit(1)).alias("sample_count"), *present]


def overall(results: DataFrame) -> DataFrame:
    """Global means; a row of zeros when there are no results."""
    return results.agg(*_means(results))


def by_bucket(results: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """Means per bucket of a fixed domain, empty buckets as zeros."""
    spark = results.sparkSession
    # The domain is a handful of fixed names.
    buckets = spark.createDataFrame([(v,) for v in domain], f"{key} string")
    grouped = results.filter(F.col(key).isin(domain)).groupBy(key).agg(*_means(results))
    joined = F.broadcast(buckets).join(grouped, key, "left")
    return joined.na.fill(0).na.fill(0.0)


def by_question_type(results: DataFrame) -> DataFrame:
    return by_bucket(results, "question_type", fv.QUESTION_TYPES)


def by_source_type(results: DataFrame) -> DataFrame:
    return by_bucket(results, "source_type", fv.SOURCE_TYPES)


def multiturn(results: DataFrame) -> DataFrame:
    return overall(results.filter(F.coalesce(F.col("requires_multiturn"), F.lit(False))))


def trigger_rate(results: DataFrame, flag: str = "reflection_triggered") -> DataFrame:
    return results.agg(F.coalesce(F.avg(F.col(flag).cast("int")), F.lit(0.0)).alias("reflection_trigger_rate"))


# --- errors -----------------------------------------------------------------------------
def primary_error(row: dict[str, Column]) -> Column:
    """First failing stage: rewrite, retrieval, ranking, reasoning, hallucination.

    ``row`` names the inputs: requires_multiturn, rewrite_triggered,
    need_rewrite, expected_entities, rewritten_query, expected_ids,
    candidate_ids, ranked_ids, candidate_count, ranked_count,
    evidence_path_hit_rate, linked_count, citation_correctness,
    unsupported_count, grounding_score, grounded, answer_keyword_match_rate.
    """
    expected, found = row["expected_ids"], row["candidate_ids"]
    wanted = F.size(expected) > 0
    in_query = F.exists(
        row["expected_entities"], lambda e: (e != "") & F.contains(F.lower(row["rewritten_query"]), F.lower(e))
    )
    rewrite = row["requires_multiturn"] & (
        (~row["rewrite_triggered"] & row["need_rewrite"]) | ((F.size(row["expected_entities"]) > 0) & ~in_query)
    )
    retrieval = (
        (wanted & (F.size(found) > 0) & ~F.arrays_overlap(expected, found))
        | ((row["candidate_count"] == 0) & (row["evidence_path_hit_rate"] <= 0))
        | ((F.size(row["expected_entities"]) > 0) & (row["linked_count"] == 0))
    )
    ranking = (
        (wanted & (F.size(row["ranked_ids"]) > 0) & ~F.arrays_overlap(expected, row["ranked_ids"]) & F.arrays_overlap(expected, found))
        | ((row["candidate_count"] > 0) & (row["ranked_count"] == 0))
        | ((row["candidate_count"] > 0) & (row["ranked_count"] > 0) & (row["citation_correctness"] <= 0))
    )
    reasoning = (row["unsupported_count"] > 0) & (row["grounding_score"] < 0.1)
    hallucination = ~row["grounded"] | (
        (row["citation_correctness"] < 0.2) & (row["answer_keyword_match_rate"] < 0.3)
    )
    return (
        F.when(rewrite, "rewrite_error")
        .when(retrieval, "retrieval_error")
        .when(ranking, "ranking_error")
        .when(reasoning, "reasoning_error")
        .when(hallucination, "answer_hallucination")
        .when(row["answer_keyword_match_rate"] < 0.2, "reasoning_error")
        .otherwise("none")
    )


def error_distribution(errors: DataFrame, column: str = "primary_error_type") -> DataFrame:
    """(error, n, ratio) without the rows that have none."""
    counted = errors.filter(F.coalesce(F.col(column), F.lit("none")).isin("none", "") == F.lit(False)).groupBy(column).agg(
        F.count(F.lit(1)).alias("n")
    )
    # One row per error class: the window runs over a handful of rows.
    return counted.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))


def most_common(rows: DataFrame, column: str, order: str) -> DataFrame:
    """The mode, the value seen first winning a tie."""
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    return counted.orderBy(F.desc("n"), F.asc("first_seen")).limit(1)


def error_matrix(errors: DataFrame, bucket: str, classes: list[str], column: str = "primary_error_type") -> DataFrame:
    """Cross table bucket x error class."""
    kept = errors.filter(F.col(column) != "none").withColumn(
        bucket, F.when(tx.text_or_empty(F.col(bucket)) == "", "unknown").otherwise(F.col(bucket))
    )
    return kept.groupBy(bucket).pivot(column, classes).count().na.fill(0)


# --- worst samples and bottlenecks ----------------------------------------------------------
def sample_score() -> Column:
    terms = [w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in fv.WORST_SAMPLE_WEIGHTS.items()]
    return reduce(lambda a, b: a + b, terms)


def worst_samples(results: DataFrame, order: str, top_n: int = 10) -> DataFrame:
    return results.withColumn("sample_score", F.round(sample_score(), 12)).orderBy("sample_score", order).limit(top_n)


def worst_by_bucket(results: DataFrame, bucket: str, order: str, top_n: int = 3) -> DataFrame:
    """The lowest-scoring rows of every bucket."""
    named = F.when(tx.text_or_empty(F.col(bucket)) == "", "unknown").otherwise(F.col(bucket))
    window = Window.partitionBy(bucket).orderBy("sample_score", order)
    return (
        results.withColumn(bucket, named)
        .withColumn("sample_score", F.round(sample_score(), 12))
        .withColumn("n", F.row_number().over(window))
        .filter(F.col("n") <= top_n)
    )


def weakest_metric(metrics: DataFrame) -> DataFrame:
    """Add the name and value of the lowest metric, the first one on a tie."""
    entries = [
        F.struct(F.col(column).alias("value"), F.lit(i).alias("i"), F.lit(name).alias("name"))
        for i, (name, column) in enumerate(fv.BOTTLENECK_METRICS)
    ]
    least = F.array_min(F.array(*entries))
    return metrics.withColumn("weakest", F.when(F.col("sample_count") > 0, least["name"])).withColumn(
        "weakest_value", F.when(F.col("sample_count") > 0, F.round(least["value"], 4))
    )


def bottleneck_text(metrics: DataFrame, bucket: str, prefix: str) -> DataFrame:
    rated = weakest_metric(metrics)
    return rated.withColumn(
        "summary",
        F.when(
            F.col("sample_count") > 0,
            F.concat(F.lit(prefix), bucket, F.lit("主要短板在 "), "weakest", F.lit("（"), F.col("weakest_value").cast("string"), F.lit("）。")),
        ).otherwise(F.concat(F.lit(prefix), bucket, F.lit("暂无样本。"))),
    )


def strategy_drift(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one-row match summary, mismatch pattern counts)."""
    expected = tx.text_or_empty(F.col("expected_retrieval_strategy"))
    actual = tx.text_or_empty(F.col("actual_retrieval_strategy"))
    rated = results.filter(expected != "").select(expected.alias("e"), actual.alias("a"))
    summary = rated.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(F.col("e") == F.col("a")).alias("match_count"),
        F.count_if(F.col("e") != F.col("a")).alias("mismatch_count"),
        F.coalesce(F.avg((F.col("e") == F.col("a")).cast("int")), F.lit(0.0)).alias("match_rate"),
    )
    patterns = (
        rated.filter("e <> a")
        .groupBy(F.concat("e", F.lit("->"), F.when(F.col("a") == "", "unknown").otherwise(F.col("a"))).alias("pattern"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return summary, patterns


# --- benchmark rows ----------------------------------------------------------------------------
def infer_question_type(category: Column, query: Column, requires_multiturn: Column) -> Column:
    c, q = F.lower(tx.text_or_empty(category)), tx.text_or_empty(query)
    by_category = tx.first_value(c, fv.CATEGORY_QUESTION_TYPES)
    return (
        F.when(F.coalesce(requires_multiturn, F.lit(False)), "multiturn_followup")
        .when(by_category.isNotNull(), by_category)
        .when(tx.contains_any(q, ["一定要", "是不是"]), "concept_definition")
        .when(c.contains("案例") | tx.contains_any(q, ["法院", "案件"]), "case_reasoning")
        .when(c.contains("法条") | tx.contains_any(q, ["哪一条", "依据哪条"]), "statute_lookup")
        .otherwise("concept_definition")
    )


def infer_source_type(category: Column, query: Column, strategy: Column) -> Column:
    c, q, s = F.lower(tx.text_or_empty(category)), tx.text_or_empty(query), F.lower(tx.text_or_empty(strategy))
    by_category = tx.first_value(c, fv.CATEGORY_SOURCE_TYPES)
    about_case = c.contains("案例") | tx.contains_any(q, ["法院", "案件"])
    about_law = c.contains("法条") | tx.contains_any(q, ["哪一条", "依据哪条"])
    return (
        F.when(by_category.isNotNull(), by_category)
        .when(s == "graph", "statute_only")
        .when(s == "vector", "case_only")
        .when(s == "hybrid", "hybrid")
        .when(about_case & (c.contains("法条") | q.contains("依据")), "hybrid")
        .when(about_case, "case_only")
        .when(about_law, "statute_only")
        .otherwise("hybrid")
    )


def infer_strategy(question_type: Column, source_type: Column) -> Column:
    return (
        F.when(question_type == "multiturn_followup", "hybrid")
        .when(source_type == "statute_only", "graph")
        .when(source_type == "case_only", "vector")
        .otherwise("hybrid")
    )


def normalize_benchmark(rows: DataFrame) -> DataFrame:
    """Defaults and label correction of benchmark questions.

    Needs ``query``, ``category``, ``question_type``, ``source_type``,
    ``requires_multiturn``, ``expected_retrieval_strategy``; other columns pass through.
    """
    inferred_q = infer_question_type(F.col("category"), F.col("query"), F.col("requires_multiturn"))
    given_q = tx.text_or_empty(F.col("question_type"))
    kind = F.when(given_q.isin(fv.QUESTION_TYPES), given_q).otherwise(inferred_q)
    kind = F.when(
        given_q.isin("", "concept_definition") & (kind == "concept_definition") & inferred_q.isin(
            "statute_lookup", "case_reasoning", "multiturn_followup"
        ),
        inferred_q,
    ).otherwise(kind)
    strategy = F.lower(tx.text_or_empty(F.col("expected_retrieval_strategy")))
    inferred_s = infer_source_type(F.col("category"), F.col("query"), F.col("expected_retrieval_strategy"))
    given_s = tx.text_or_empty(F.col("source_type"))
    source = F.when(given_s.isin(fv.SOURCE_TYPES), given_s).otherwise(inferred_s)
    source = F.when(
        given_s.isin("", "hybrid") & (source == "hybrid") & inferred_s.isin("statute_only", "case_only")
        & strategy.isin("", "graph", "vector"),
        inferred_s,
    ).otherwise(source)
    named = rows.withColumns({"__q": kind, "__s": source})
    given = tx.text_or_empty(F.col("expected_retrieval_strategy"))
    return named.withColumns(
        {
            "query": tx.strip(tx.text_or_empty(F.col("query"))),
            "question_type": F.col("__q"),
            "source_type": F.col("__s"),
            "requires_multiturn": F.coalesce("requires_multiturn", F.col("__q") == "multiturn_followup"),
            "expected_retrieval_strategy": F.when(given != "", F.col("expected_retrieval_strategy")).otherwise(
                infer_strategy(F.col("__q"), F.col("__s"))
            ),
        }
    ).drop("__q", "__s")


def stratified_sample(rows: DataFrame, size: int, seed: int, id_col: str = "id") -> DataFrame:
    """One seeded pick per question type, then rows in id order, up to ``size``."""
    types = ["statute_lookup", "case_reasoning", "multiturn_followup", "concept_definition"]
    picks = (
        rows.filter(F.col("question_type").isin(types))
        .groupBy("question_type")
        .agg(F.min(F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("h"), F.col(id_col))).alias("p"))
        .select(F.col(f"p.{id_col}").alias(id_col), F.lit(0).alias("pass"))
    )
    ordered = rows.join(F.broadcast(picks), id_col, "left").withColumn("pass", F.coalesce("pass", F.lit(1)))
    position = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("question_type"))
    first = F.when(F.col("pass") == 0, position).otherwise(F.lit(0))
    return ordered.orderBy("pass", first, id_col).limit(max(0, size)).drop("pass")
