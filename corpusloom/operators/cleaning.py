"""The cleaned release: spans and links that pass the quality rules, their exclusions by reason, hierarchy checks and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

#: Fields of a commentary, and the fields that links join; fixed values
COMMENTARY_FIELDS = ("kurippurai", "pozhppurai")
SOURCE_FIELD, TARGET_FIELD = "paadal_text", "pozhppurai"


def substring_matches(parent: Column, own: Column, start: Column, end: Column) -> Column:
    """Whether a span's text is what its parent has at its offsets."""
    inside = start.isNotNull() & end.isNotNull() & (start >= 0) & (end >= start) & (end <= F.length(parent))
    return F.coalesce(inside & (F.substring(parent, (start + 1).cast("int"), (end - start).cast("int")) == own), F.lit(False))


def book_of(paadal_id: Column) -> Column:
    """The number of the book in a passage's id, or null."""
    return F.nullif(F.regexp_extract(paadal_id, r"thirumurai_(\d+)_", 1), F.lit("")).cast("int")


def clean_spans(spans: DataFrame, parents: DataFrame, scope: list[int], script=tx.tamil_characters) -> DataFrame:
    """Every span of a book in scope with quality_status, quality_flags (by `|`), token_count and offsets_match_parent.

    spans: span_id, parent_id, field_name, text, start_char, end_char. parents: parent_id, field_name, parent_text, book.
    """
    rows = spans.join(parents, ["parent_id", "field_name"], "left").where(F.col("book").isin(*scope))
    rows = rows.withColumns({"_q": tx.text_quality(F.col("text"), script=script), "offsets_match_parent": substring_matches(F.coalesce("parent_text", F.lit("")), F.col("text"), F.col("start_char"), F.col("end_char"))})
    keep = (F.col("_q.status") == "keep") & F.col("offsets_match_parent")
    flags = F.concat("_q.flags", F.when(~F.col("offsets_match_parent"), F.array(F.lit("offset_mismatch"))).otherwise(F.array().cast("array<string>")))
    kind = F.when(F.col("field_name").isin(*COMMENTARY_FIELDS), "commentary_span").otherwise("paadal_span")
    return rows.withColumns(
        {
            "node_kind": kind, "quality_status": F.when(keep, "keep").otherwise("reject"), "quality_flags": F.array_join(flags, "|"), "token_count": F.col("_q.token_count"), "script_chars": F.col("_q.script_chars"),
            "in_link_scope": F.col("field_name").isin(SOURCE_FIELD, TARGET_FIELD),
        }
    ).drop("_q", "parent_text")


def span_issues(cleaned: DataFrame) -> DataFrame:
    """Spans that were rejected or are more than plainly clean."""
    return cleaned.where("quality_status <> 'keep' or quality_flags <> 'clean'").select(F.col("node_kind").alias("issue_scope"), F.col("span_id").alias("record_id"), "field_name", F.col("quality_flags").alias("issue_flags"), "quality_status", "text")


def exclusion_reasons(scope: list[int], script=tx.tamil_characters) -> Column:
    """All reasons against a link, in order; none keeps it. Rows: book, source_field, target_field, texts, offsets, full_source, full_target."""
    quality = {side: tx.text_quality(F.col(f"{side}_text"), script=script) for side in ("source", "target")}
    none = F.array().cast("array<string>")
    one = lambda held, name: F.when(held, F.array(F.lit(name))).otherwise(none)
    parts = [
        one(~F.coalesce(F.col("book").isin(*scope), F.lit(False)), "not_main_scope"), one(~F.col("source_field").eqNullSafe(F.lit(SOURCE_FIELD)), "source_field_not_paadal_text"),
        one(~F.col("target_field").eqNullSafe(F.lit(TARGET_FIELD)), "target_field_not_pozhippurai"),
    ]
    for side, q in quality.items():
        parts.append(F.when(q["status"] != "keep", F.array(F.concat(F.lit(f"{side}_"), q["flags"][0]))).otherwise(none))  # a rejected text has one flag
    for side in quality:
        parts.append(one(~substring_matches(F.coalesce(f"full_{side}", F.lit("")), F.col(f"{side}_text"), F.col(f"{side}_start_char"), F.col(f"{side}_end_char")), f"{side}_offset_mismatch"))
    return F.concat(*parts)


def candidate_pool(links: DataFrame, scope: list[int], script=tx.tamil_characters) -> tuple[DataFrame, DataFrame]:
    """Clean candidates with the mild flags of both texts, and excluded links with their reasons joined by `|`."""
    rows = links.withColumn("_reasons", exclusion_reasons(scope, script))
    mild = F.array_except(F.array_union(tx.text_quality(F.col("source_text"), script=script)["flags"], tx.text_quality(F.col("target_text"), script=script)["flags"]), F.array(F.lit("clean")))
    kept = rows.where(F.size("_reasons") == 0).withColumn("quality_flags", F.when(F.size(mild) > 0, F.array_join(F.array_sort(mild), "|")).otherwise("clean")).drop("_reasons")
    lost = rows.where(F.size("_reasons") > 0).withColumn("exclusion_reasons", F.array_join("_reasons", "|")).drop("_reasons")
    return kept, lost


def reason_counts(excluded: DataFrame) -> DataFrame:
    return excluded.select(F.explode(F.split("exclusion_reasons", r"\|")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def missing_commentary(passages: DataFrame, kept: DataFrame, scope: list[int]) -> DataFrame:
    """passage_id, book, category of passages without a commentary, and of those that have one but no clean link."""
    linked = kept.select(F.col("passage_id").alias("_linked")).distinct()
    rows = passages.where(F.col("book").isin(*scope)).join(linked, F.col("passage_id") == F.col("_linked"), "left")
    category = F.when(tx.missing(F.col("pozhppurai")).isNull(), "true_missing_pozhippurai").when(F.col("_linked").isNull(), "usable_pozhippurai_but_no_clean_link")
    return rows.withColumn("category", category).where("category is not null").select("passage_id", "book", "category")


def coverage_by_book(missing: DataFrame) -> DataFrame:
    """A row for each book with the number of passages of either category."""
    names = ("true_missing_pozhippurai", "usable_pozhippurai_but_no_clean_link")
    return missing.groupBy("book").agg(*[F.count_if(F.col("category") == n).alias(n) for n in names])


def orphans(name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str, within: Column | None = None) -> DataFrame:
    """code, key of children in scope whose parent is not there; a null key has none."""
    rows = child if within is None else child.where(within)
    return rows.join(parent.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_anti").select(F.lit(name).alias("code"), F.col(key).cast("string").alias("key"))


def hierarchy(issues: list[DataFrame], codes: list[str]) -> DataFrame:
    """code, n, status of each check; VALID only if nothing was found by any."""
    spark = issues[0].sparkSession
    found = reduce(DataFrame.unionByName, issues).groupBy("code").agg(F.count("*").alias("n"))
    rows = spark.createDataFrame([(c,) for c in codes], "code string").join(found, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = rows.agg(F.sum("n").alias("_all"))
    return rows.join(F.broadcast(total), F.lit(True)).select("code", "n", F.when(F.col("_all") == 0, "VALID").otherwise("NEEDS_REVIEW").alias("status"))
