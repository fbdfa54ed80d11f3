"""Data-quality audits: keys, references, order, coverage, changes and distributions. Violations are rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def foreign_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """check, bad_rows, bad_keys: references that no parent row has."""
    lost = child.join(parent.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_anti")
    return lost.agg(F.lit(name).alias("check"), F.count("*").alias("bad_rows"), F.count_distinct(key).alias("bad_keys"))


def one_to_one(parent: DataFrame, parent_key: str, child: DataFrame, key: str) -> DataFrame:
    """parent key and number of child rows, where that is not 1."""
    counts = child.groupBy(F.col(key).alias("_child")).agg(F.count("*").alias("n"))
    rows = parent.select(parent_key).join(counts, F.col(parent_key) == F.col("_child"), "left").select(parent_key, F.coalesce("n", F.lit(0)).alias("n"))
    return rows.where("n <> 1")


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def many_owners(rows: DataFrame, alias: str, owner: str) -> DataFrame:
    """Values of alias that belong to more than one owner."""
    return rows.groupBy(alias).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def contiguity(rows: DataFrame, group: str, number: str, first: int = 1) -> DataFrame:
    """group, n, low, high, distinct_numbers, contiguous: whether numbers run from first to n without gap or repeat."""
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), F.count_distinct(number).alias("distinct_numbers"))
    return out.withColumn("contiguous", (F.col("low") == first) & (F.col("high") == F.col("n") + first - 1) & (F.col("distinct_numbers") == F.col("n")))


def out_of_order(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value is below that of the row before them in the group's order."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("previous", before).where(F.col("previous") > F.col(value))


def overlapping_spans(spans: DataFrame, parent: list[str], start: str = "start_char", end: str = "end_char", name: str = "span_id") -> DataFrame:
    """Spans that begin before an earlier span of their parent has ended."""
    order = Window.partitionBy(*parent).orderBy(start, end, name).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reached", F.max(end).over(order)).where(F.col("reached") > F.col(start))


def span_mismatches(spans: DataFrame, parents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Spans whose text is not what their parent has at their offsets."""
    rows = spans.join(parents.select(F.col(key).alias("_parent"), F.col(text).alias("_text")), F.col("parent_id") == F.col("_parent").cast("string"))
    cut = F.substring("_text", (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
    return rows.where(cut != F.col("line_text")).drop("_parent", "_text")


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, present, missing, percentage; a blank text is missing."""
    has = lambda c: tx.missing(F.col(c).cast("string")).isNotNull()
    one = rows.agg(*[F.count_if(has(c)).alias(c) for c in fields], F.count("*").alias("_rows"))
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present"), (F.col("_rows") - F.col(c)).alias("missing"), (F.col(c) * 100 / F.col("_rows")).alias("percentage")) for c in fields])
    return one.select(F.inline(each))


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, changed: rows of a key whose field differs between two versions of a table."""
    other = after.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in fields])
    one = before.join(other, F.col(key) == F.col("_key")).agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(c) for c in fields])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("changed")) for c in fields])))


def nearest_rank(rows: DataFrame, value: str, shares: list[float], group: str | None = None) -> DataFrame:
    """p and the value at the position round((n - 1) * p), halves to even, of the sorted values; by group if one is given.

    Counts by distinct value are summed up, so the values of a group are never gathered.
    """
    keys = [group] if group else []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(value)
    counts = counts.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy(*keys))})
    wanted = counts.withColumn("p", F.explode(F.array(*map(F.lit, shares)))).withColumn("at", F.bround((F.col("all") - 1) * F.col("p"), 0))
    return wanted.where("at < upto and at >= upto - n").select(*keys, "p", F.col(value).alias("value"))


def issues(rows: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """key, severity, code: a row for each rule that a row of the table violates."""
    each = F.array_compact(F.array(*[F.when(held, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, held in rules]))
    return rows.select(F.col(key).cast("string").alias("key"), F.inline(each))


def audit(*found: DataFrame) -> DataFrame:
    """severity, code, n over several issue tables, most severe first."""
    rows = reduce(DataFrame.unionByName, found)
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "major", 1).when(F.col("severity") == "minor", 2).otherwise(3)
    return rows.groupBy("severity", "code").agg(F.count("*").alias("n")).orderBy(rank, "code")


def score_from_penalties(*penalties: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.lit(100) - reduce(lambda a, b: a + b, penalties, F.lit(0.0)), 0))).cast("bigint")
