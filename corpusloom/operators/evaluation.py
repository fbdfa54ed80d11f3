"""Retrieval and agreement metrics, learned pattern scores and failure attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def per_query(queries: DataFrame, results: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, hits at each cut, reciprocal_rank, relevant, missing (expected ids not found) of every query.

    results: query_id, rank, record_id. expected: query_id, record_id.
    """
    good = results.join(expected, ["query_id", "record_id"], "left_semi")
    ranks = good.groupBy("query_id").agg(F.min("rank").alias("first"), F.count("*").alias("relevant"))
    lost = expected.join(results, ["query_id", "record_id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("missing"))
    rows = queries.select("query_id").join(ranks, "query_id", "left").join(lost, "query_id", "left")
    hit = {f"hit_at_{k}": F.coalesce(F.col("first") <= k, F.lit(False)) for k in CUTS}
    return rows.withColumns(hit | {"reciprocal_rank": F.coalesce(1 / F.col("first"), F.lit(0.0)), "relevant": F.coalesce("relevant", F.lit(0)), "missing": F.coalesce("missing", F.lit(0))}).drop("first")


def metrics(evaluated: DataFrame) -> DataFrame:
    """One row: queries, recall at the cuts, MRR, failed."""
    return evaluated.agg(
        F.count("*").alias("queries"), *[F.avg(F.col(f"hit_at_{k}").cast("int")).alias(f"recall_at_{k}") for k in CUTS], F.avg("reciprocal_rank").alias("mrr"), F.count_if(~F.col("hit_at_10")).alias("failed")
    )


def failure(first_rank: Column, results: Column, document_frequency: Column) -> Column:
    """Why a query failed, by ordered rules."""
    return (
        F.when(first_rank <= 10, "passed").when(F.coalesce(document_frequency, F.lit(0)) == 0, "vocabulary_gap").when(F.coalesce(results, F.lit(0)) == 0, "no_candidates")
        .when(first_rank.isNull(), "not_retrieved").otherwise("ranked_low")
    )


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed, expected, kappa of two raters; pairs with a null don't count."""
    table = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    # The product of marginals belongs to labels that both raters use: the diagonal, whether or not they ever agree on one.
    by_a, by_b = table.groupBy("a").agg(F.sum("n").alias("na")), table.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = by_a.join(by_b, F.col("a") == F.col("b")).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    one = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    one = one.join(chance, F.lit(True)).select("n", (F.col("same") / F.col("n")).alias("observed"), (F.coalesce("chance", F.lit(0)) / (F.col("n") * F.col("n"))).alias("expected"))
    return one.withColumn("kappa", F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def learn_patterns(rows: DataFrame, relation: str, features) -> DataFrame:
    """relation, feature, n: how often a relation's rows have a feature."""
    return rows.select(F.col(relation).alias("relation"), F.explode(F.array_distinct(features)).alias("feature")).groupBy("relation", "feature").agg(F.count("*").alias("n"))


#: Most of each part of a learned score; fixed values
PART_CAPS = {"rule": 0.35, "anchor": 0.25, "source_token": 0.15, "target_token": 0.15}
LEAST_TOKEN_COUNT = 3


def _tagged(parts: dict[str, Column], sequence: Column) -> Column:
    """All features as struct(part, feature)."""

    def under(part: str):
        return lambda x: F.struct(F.lit(part).alias("part"), x.alias("feature"))

    return F.flatten(F.array(*[F.transform(F.array_distinct(f), under(p)) for p, f in [*parts.items(), ("sequence", F.array(sequence))]]))


def pattern_scores(rows: DataFrame, key: str, relation: str, parts: dict[str, Column], learned: DataFrame, sequence: Column, signal: Column) -> DataFrame:
    """key, learned_<part>_score, learned_sequence_score, existing_semantic_signal, learned_pattern_score, evidence.

    parts: arrays of features by part (PART_CAPS). learned: relation, part, feature, n, with sequence methods as a part of that name.
    Each part is min(cap, sum of ln(1 + n) / 35) over its features; tokens count from LEAST_TOKEN_COUNT on. signal: the sum of semantic features.
    """
    each = _tagged(parts, sequence)
    own = rows.select(key, F.col(relation).alias("relation"), F.inline(each))
    hits = own.join(learned, ["relation", "part", "feature"]).where(~F.col("part").endswith("_token") | (F.col("n") >= LEAST_TOKEN_COUNT))
    sums = hits.groupBy(key).agg(
        *[F.sum(F.when(F.col("part") == p, F.log1p("n"))).alias(f"_{p}") for p in parts], F.max(F.when(F.col("part") == "sequence", F.log1p("n"))).alias("_sequence")
    )
    out = rows.select(key, signal.alias("_signal")).join(sums, key, "left")
    scores = {f"learned_{p}_score": F.least(F.lit(PART_CAPS[p]), F.coalesce(F.col(f"_{p}") / 35, F.lit(0.0))) for p in parts}
    scores |= {"learned_sequence_score": F.least(F.lit(0.1), F.coalesce(F.col("_sequence") / 60, F.lit(0.0))), "existing_semantic_signal": F.least(F.lit(0.25), F.col("_signal") / 5)}
    token = F.lit(False)
    for p in parts:
        token = token | (F.col(f"_{p}").isNotNull() if p.endswith("_token") else F.lit(False))
    seen = lambda p: F.col(f"_{p}").isNotNull() if p in parts else F.lit(False)
    evidence = F.array_compact(F.array(F.when(seen("rule"), "rule"), F.when(seen("anchor"), "anchor"), F.when(token, "token"), F.when(F.col("_signal") >= 0.75, "semantic")))
    total = F.bround(sum(scores.values(), F.lit(0.0)), 4)
    return out.select(key, *[v.alias(n) for n, v in scores.items()], total.alias("learned_pattern_score"), evidence.alias("evidence"))


def learned_parts(rows: DataFrame, relation: str, parts: dict[str, Column], sequence: Column) -> DataFrame:
    """relation, part, feature, n: what `pattern_scores` takes, learned from rows that are examples."""
    each = _tagged(parts, sequence)
    return rows.select(F.col(relation).alias("relation"), F.inline(each)).groupBy("relation", "part", "feature").agg(F.count("*").alias("n"))


#: (least score, tier) of a calibrated score, from the top; fixed values
TIERS = ((0.78, "high"), (0.50, "medium"), (0.25, "low"))


def calibrated(base: Column, weighted: Column, penalties: Column) -> Column:
    """Linear final score: clamp(.45 base + 1.9 weighted + .04 - penalties) to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.45 * base + 1.9 * weighted + 0.04 - penalties))


def tier(score: Column) -> Column:
    out = F.lit("none")
    for least, name in reversed(TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def change(before: list[Column], after: list[Column]) -> Column:
    """improved, degraded or neutral by lexicographic comparison."""
    a, b = F.struct(*before), F.struct(*after)
    return F.when(b > a, "improved").when(b < a, "degraded").otherwise("neutral")
