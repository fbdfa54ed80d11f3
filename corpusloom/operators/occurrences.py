"""Occurrence search, its grouping and its statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.generate import generated

GROUP_KEYS = {"author": "author", "work": "work", "source": "source", "category": "category_id", "corpus": "corpus_id"}
UNKNOWN = "(unknown)"


def starts_of(text: str, term: str) -> Iterator[int]:
    """0-based starts of all occurrences of a term, overlapping ones too."""
    at = text.find(term)
    while at >= 0:
        yield at
        at = text.find(term, at + 1)


def index_rows(records: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """One row for each non-empty text field of a record, named by a hash of its keys."""
    rows = records.unpivot(ids, fields, "field_name", "text").where("text <> ''")
    return rows.withColumn("index_id", tx.stable_hash(*map(F.col, ids[:1]), F.col("field_name"), length=16)).withColumn("text_length", F.length("text"))


def search(index: DataFrame, terms: list[str]) -> DataFrame:
    """index rows (record_id, field_name, text, ...) by occurrence, without the text: matched_term, match_start, match_end, snippet, deterministic_key.

    Texts are read once, where they are; a snippet is cut while its place is known, so hits cost what they hold.
    """
    terms = [t for t in dict.fromkeys(terms) if t]

    def make():
        def find(text):
            for term in terms:
                for at in starts_of(text or "", term):
                    yield term, at, at + len(term), snippet(text, at, at + len(term))

        return find

    any_term = reduce(lambda a, b: a | b, [F.contains("text", F.lit(t)) for t in terms], F.lit(False))
    keep = [c for c in index.columns if c != "text"]
    rows = generated(index.where(any_term), keep, ["text"], "matched_term string, match_start bigint, match_end bigint, snippet string", make)
    return rows.withColumn("deterministic_key", F.concat_ws(":", "record_id", "field_name", "matched_term", "match_start"))


def snippet(text: str, start: int, end: int, radius: int = tx.SNIPPET_RADIUS) -> str:
    """Keyword in context, with `...` where the text goes on."""
    cut = text[max(0, start - radius) : end + radius].strip()
    return f"{'...' if start > radius else ''}{cut}{'...' if end + radius < len(text) else ''}"


def group_value(group_by: str) -> Column:
    if group_by not in GROUP_KEYS:
        raise ValueError(f"unsupported group_by: {group_by}")
    return F.coalesce(tx.missing(F.col(GROUP_KEYS[group_by]).cast("string")), F.lit(UNKNOWN))


def _counts(key: str) -> Column:
    """A map from values to their numbers; the values are few (terms, fields)."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n"))))


def group(occurrences: DataFrame, group_by: str = "author", top_n: int = 10, total: int | None = None) -> DataFrame:
    """Occurrences by group: counts, percentage, distinct records, works and authors, counts by term and field, first three examples.

    Ordered by count, then key. Terms and fields are counted before they are gathered, and examples are the smallest
    three keys by a window with a limit, so a group of any size is never collected. total: the count before a limit, if one was set.
    """
    rows = occurrences.withColumn("group_key", group_value(group_by))
    present = lambda c: F.count_distinct(tx.missing(F.col(c).cast("string")))
    example = F.struct("deterministic_key", "record_id", "matched_term", "matched_field", "snippet")
    rows = rows.withColumnRenamed("field_name", "matched_field")
    base = rows.groupBy("group_key").agg(
        F.count("*").alias("occurrence_count"), present("record_id").alias("unique_records"), present("work").alias("unique_works"), present("author").alias("unique_authors")
    )
    by_term = rows.groupBy("group_key", "matched_term").agg(F.count("*").alias("n")).groupBy("group_key").agg(_counts("matched_term").alias("matched_term_counts"))
    by_field = rows.groupBy("group_key", "matched_field").agg(F.count("*").alias("n")).groupBy("group_key").agg(_counts("matched_field").alias("field_counts"))
    first = Window.partitionBy("group_key").orderBy("deterministic_key")
    examples = rows.withColumn("nth", F.row_number().over(first)).where("nth <= 3").groupBy("group_key").agg(F.array_sort(F.collect_list(example)).alias("example_records"))
    whole = F.lit(total) if total is not None else F.sum("occurrence_count").over(Window.partitionBy())
    out = base.withColumn("percentage", tx.python_round(F.col("occurrence_count") / whole * 100, 4)).withColumn("group_by", F.lit(group_by))
    out = out.join(by_term, "group_key").join(by_field, "group_key").join(examples, "group_key").orderBy(F.desc("occurrence_count"), "group_key")
    return out.limit(top_n) if top_n else out


def distribution(rows: DataFrame, key: str) -> DataFrame:
    """value, count and percentage of all, by count and then value."""
    out = rows.groupBy(F.col(key).cast("string").alias("value")).agg(F.count("*").alias("count"))
    out = out.withColumn("percentage", tx.python_round(F.col("count") / F.sum("count").over(Window.partitionBy()) * 100, 4))
    return out.orderBy(F.desc("count"), "value")


def statistics(occurrences: DataFrame) -> DataFrame:
    """One row: total and distinct records, works and authors."""
    present = lambda c: F.count_distinct(tx.missing(F.col(c).cast("string")))
    return occurrences.agg(F.count("*").alias("total"), present("record_id").alias("records"), present("work").alias("works"), present("author").alias("authors"))
