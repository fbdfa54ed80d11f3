"""Benchmark runs as tables: cases checked against observations, failures attributed, capabilities classified, rates summed up.

Cases have case_id, category, query and a struct expected; observations have case_id and a struct observed, with fields
intent, term, expanded, group_by, matched_terms (array), total_occurrences, top_group_key and evidence_samples (count).
A null observation says that nothing was produced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence of each kind of attribution; fixed values
ATTRIBUTION = (
    ("architecture_gap", 0.95), ("analytics_gap", 0.92), ("analytics_gap", 0.90), ("query_expansion_gap", 0.88), ("synonym_gap", 0.86), ("data_gap", 0.84), ("occurrence_gap", 0.84),
    ("aggregation_gap", 0.82), ("metadata_gap", 0.78), ("occurrence_gap", 0.76),
)
UNKNOWN = ("unknown", 0.40)
FAILURE_TYPES = (
    "data_gap", "parser_gap", "metadata_gap", "retrieval_gap", "query_expansion_gap", "synonym_gap", "occurrence_gap", "aggregation_gap", "analytics_gap", "registry_gap", "architecture_gap",
    "evaluation_gap", "unknown",
)
#: Confidence that a capability's failure has its type; a partial one is PARTIAL_CONFIDENCE; fixed values
CAPABILITY_CONFIDENCE = {"data_gap": 0.86, "architecture_gap": 0.88, "registry_gap": 0.84, "aggregation_gap": 0.76, "evaluation_gap": 0.70}
PARTIAL_CONFIDENCE, OTHER_CONFIDENCE = 0.68, 0.60
#: Words of questions that ask for epithets, and for place names or sets; fixed values
EPITHET_WORDS = ("அடைமொழி", "வர்ணிக்க", "புராண", "அடையாள")
SET_WORDS = ("தலப்பெயர்கள்", "ஒவ்வொரு", "ஒரே")
ANALYTICAL_WORDS = ("எந்த ஆசிரியர்", "எந்த corpus", "works-இல்", "record types")


def _told(value: Column) -> Column:
    """Whether an expectation is given at all: not null and not empty."""
    return value.isNotNull() & (value.cast("string") != "")


def attributed(expected: str = "expected", observed: str = "observed") -> Column:
    """struct(failure_type, confidence) of a mismatch by the first rule that holds."""
    e, o = (lambda f: F.col(f"{expected}.{f}")), (lambda f: F.col(f"{observed}.{f}"))
    differs = lambda f: _told(e(f)) & ~o(f).eqNullSafe(e(f))
    lacking = F.size(F.array_except(F.coalesce(e("required_matched_terms"), F.array().cast("array<string>")), F.coalesce(o("matched_terms"), F.array().cast("array<string>")))) > 0
    total = F.coalesce(o("total_occurrences"), F.lit(0))
    few = e("min_total_occurrences").isNotNull() & (total < e("min_total_occurrences"))
    rules = [
        F.col(observed).isNull(), differs("intent"), differs("term"), F.coalesce(e("expanded"), F.lit(False)) & ~F.coalesce(o("expanded"), F.lit(False)), lacking, few & (total == 0), few,
        differs("top_group_key"), differs("group_by"), F.coalesce(e("requires_evidence_samples"), F.lit(False)) & (F.coalesce(o("evidence_samples"), F.lit(0)) == 0),
    ]
    kind = lambda x: F.struct(F.lit(x[0]).alias("failure_type"), F.lit(x[1]).alias("confidence"))
    out = kind(UNKNOWN)
    for held, name in reversed(list(zip(rules, ATTRIBUTION, strict=True))):
        out = F.when(F.coalesce(held, F.lit(False)), kind(name)).otherwise(out)
    return out


def checks(expected: str = "expected", observed: str = "observed") -> Column:
    """struct of booleans: what of an expectation an observation meets."""
    e, o = (lambda f: F.col(f"{expected}.{f}")), (lambda f: F.col(f"{observed}.{f}"))
    none = F.array().cast("array<string>")
    return F.struct(
        o("intent").eqNullSafe(e("intent")).alias("intent"), o("term").eqNullSafe(e("term")).alias("term"), (e("expanded").isNull() | o("expanded").eqNullSafe(e("expanded"))).alias("expanded"),
        (e("group_by").isNull() | o("group_by").eqNullSafe(e("group_by"))).alias("group_by"),
        (F.coalesce(o("total_occurrences"), F.lit(0)) >= F.coalesce(e("min_total_occurrences"), F.lit(0))).alias("minimum_total"),
        (~_told(e("top_group_key")) | o("top_group_key").eqNullSafe(e("top_group_key"))).alias("top_group"),
        (F.size(F.array_except(F.coalesce(e("required_matched_terms"), none), F.coalesce(o("matched_terms"), none))) == 0).alias("matched_terms"),
        (~F.coalesce(e("requires_evidence_samples"), F.lit(False)) | (F.coalesce(o("evidence_samples"), F.lit(0)) > 0)).alias("evidence_samples"),
    )


def evaluated_cases(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """case_id, category, classification, checks, failure_type, confidence of every case."""
    rows = cases.join(observations, "case_id", "left").withColumn("checks", checks())
    names = [f.name for f in rows.schema["checks"].dataType]
    all_met = F.lit(True)
    for n in names:
        all_met = all_met & F.col(f"checks.{n}")
    unsupported = F.col("expected.intent") == "unsupported"
    some = F.col("checks.intent") & F.col("checks.term") & (F.coalesce("observed.total_occurrences", F.lit(0)) > 0)
    kind = F.when(unsupported, F.when(F.col("observed.intent") == "unsupported", "success").otherwise("failure")).when(all_met, "success").when(some, "partial_success").otherwise("failure")
    why = attributed()
    rows = rows.withColumn("classification", kind).withColumn("_why", F.when(F.col("classification") != "success", why))
    return rows.select("case_id", "category", "classification", "checks", F.col("_why.failure_type").alias("failure_type"), F.col("_why.confidence").alias("confidence"))


def rates(rows: DataFrame, outcome: str, names: tuple[str, ...], by: str | None = None) -> DataFrame:
    """total, the count of each outcome and its rate to four digits; by category if one is given."""
    keys = [by] if by else []
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col(outcome) == n).alias(n) for n in names])
    return out.withColumns({f"{n}_rate": F.when(F.col("total") > 0, F.bround(F.col(n) / F.col("total"), 4)).otherwise(0.0) for n in names})


def failures(evaluated: DataFrame) -> DataFrame:
    """failure_type, n, share of all cases that did not succeed, the most frequent first."""
    whole = evaluated.agg(F.count("*").alias("_all"))
    lost = evaluated.where("classification <> 'success'").groupBy("failure_type").agg(F.count("*").alias("n"))
    return lost.join(F.broadcast(whole), F.lit(True)).select("failure_type", "n", F.bround(F.col("n") / F.col("_all"), 4).alias("share")).orderBy(F.desc("n"), "failure_type")


def known_term(question: Column, terms: tuple[str, ...]) -> Column:
    """The longest of the supported terms that a question has, else empty."""
    out = F.lit("")
    for t in sorted(terms, key=lambda t: (-len(t), t), reverse=True):
        out = F.when(F.contains(question, F.lit(t)), t).otherwise(out)
    return out


def _requires(name: str) -> Column:
    return F.coalesce(F.try_element_at("requires", F.lit(name)), F.lit(False))


def _has(words: tuple[str, ...]) -> Column:
    held = F.lit(False)
    for w in words:
        held = held | F.contains("question", F.lit(w))
    return held


def benchmark_category() -> Column:
    """Category of a question (category, requires map, question, evaluation_method) by ordered rules."""
    c = F.col("category")
    return (
        F.when(_requires("cross_corpus") | c.startswith("H."), "cross-corpus questions").when(_requires("llm_generation") | (F.col("evaluation_method") == "manual_review"), "unsupported questions")
        .when(c.startswith("G."), "author questions").when(c.startswith("E."), "deity questions").when(c.startswith("D."), "synonym questions").when(c.startswith("C."), "occurrence questions")
        .when(_requires("aggregation"), "aggregation questions").when(_has(ANALYTICAL_WORDS), "analytical questions").otherwise("ordinary retrieval")
    )


def capability(terms: tuple[str, ...]) -> Column:
    """struct(status, failure_type, supported_by): whether a question can be answered by what there is, and by which parts."""
    c, term = F.col("category"), known_term(F.col("question"), terms)
    none = F.array().cast("array<string>")
    part = lambda held, *names: F.when(held, F.array(*map(F.lit, names))).otherwise(none)
    by = F.array_sort(
        F.array_distinct(
            F.concat(
                part(_requires("retrieval"), "retrieval"), part(_requires("synonym_expansion"), "query_expansion"), part(_requires("aggregation"), "occurrence_search", "aggregation"),
                part(benchmark_category() == "analytical questions", "analytical_retrieval"),
            )
        )
    )
    out = lambda status, kind: F.struct(F.lit(status).alias("status"), F.lit(kind).alias("failure_type"))
    ruled = (
        F.when(_requires("llm_generation"), out("failure", "architecture_gap")).when(_requires("cross_corpus"), out("failure", "data_gap")).when(c.startswith("F."), out("failure", "architecture_gap"))
        .when(c.startswith("E.") & _has(EPITHET_WORDS), out("failure", "registry_gap")).when(_requires("synonym_expansion") & (term == ""), out("failure", "registry_gap"))
        .when(F.col("evaluation_method") == "manual_review", out("partial", "evaluation_gap")).when(_requires("aggregation") & (term == "") & _has(SET_WORDS), out("partial", "aggregation_gap"))
        .otherwise(out("success", ""))
    )
    return F.struct(ruled["status"].alias("status"), ruled["failure_type"].alias("failure_type"), by.alias("supported_by"))


def capability_confidence(status: Column, kind: Column) -> Column:
    out = F.lit(OTHER_CONFIDENCE)
    for name, value in CAPABILITY_CONFIDENCE.items():
        out = F.when(kind == name, value).otherwise(out)
    return F.when(status == "partial", PARTIAL_CONFIDENCE).otherwise(out)


def evaluated_questions(questions: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """question_id, category, status, failure_type, supported_by, confidence (null for a success) of every question."""
    rows = questions.select("question_id", benchmark_category().alias("benchmark_category"), capability(terms).alias("_c"))
    status, kind = F.col("_c.status"), F.col("_c.failure_type")
    return rows.select("question_id", F.col("benchmark_category").alias("category"), status.alias("status"), kind.alias("failure_type"), F.col("_c.supported_by").alias("supported_by"), F.when(status != "success", capability_confidence(status, kind)).alias("confidence"))


def question_errors(questions: DataFrame, expected: int) -> DataFrame:
    """code, question_id: ids that repeat, blank questions, and a wrong number of questions."""
    twice = questions.groupBy("question_id").count().where("count > 1").select(F.lit("duplicate_question_id").alias("code"), "question_id")
    blank = questions.where(F.trim(F.coalesce("question", F.lit(""))) == "").select(F.lit("blank_question").alias("code"), "question_id")
    number = questions.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit("unexpected_count").alias("code"), F.col("n").cast("string").alias("question_id"))
    return twice.unionByName(blank).unionByName(number)


def recovered(semantic: DataFrame, hybrid: DataFrame) -> DataFrame:
    """query_id, recovered, hybrid_rank of queries that semantic search failed (first_rank null) and hybrid search may have found."""
    return semantic.where("first_rank is null").select("query_id").join(hybrid.select("query_id", F.col("first_rank").alias("hybrid_rank")), "query_id", "left").withColumn("recovered", F.col("hybrid_rank").isNotNull())


def recovery_summary(semantic: DataFrame, hybrid: DataFrame) -> DataFrame:
    """One row: queries, failures of semantic search, those that hybrid search finds, their rate and what remains."""
    one = semantic.agg(F.count("*").alias("semantic_queries"), F.count_if(F.col("first_rank").isNull()).alias("semantic_failures"))
    back = recovered(semantic, hybrid).agg(F.count_if("recovered").alias("hybrid_recoveries"))
    n, k = F.col("semantic_failures"), F.col("hybrid_recoveries")
    return one.join(back, F.lit(True)).select("*", F.when(n > 0, F.bround(k / n, 4)).otherwise(0.0).alias("recovery_rate"), (n - k).alias("remaining"))
