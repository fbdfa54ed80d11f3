"""Summaries of tables and runs: statistics by group, score summaries, crosstabs, outcomes and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Slices of a value's range that are summed before their values are ordered.
SLICES = 4096


def group_statistics(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, low, high, total of a number; means are total / n."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"))


def score_summary(rows: DataFrame, value: str) -> DataFrame:
    """n, low, high, mean, median; the median from running counts of distinct values, so that no task holds all of them."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    one = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    # Values fall into slices of equal width; slices are summed before anything is ordered, and a slice is ordered by itself.
    width = F.col("high").cast("double") - F.col("low").cast("double")
    slices = counts.join(F.broadcast(one.select("n", "low", "high")), F.lit(True)).withColumn("slice", F.when(width > 0, F.floor((F.col("v").cast("double") - F.col("low").cast("double")) / width * SLICES)).otherwise(0))
    before = slices.groupBy("slice").agg(F.sum("c").alias("held")).withColumn("before", F.sum("held").over(Window.orderBy("slice")) - F.col("held"))
    placed = slices.join(F.broadcast(before), "slice").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("slice").orderBy("v")))
    middle = placed.where("2 * upto >= n and 2 * (upto - c) <= n")
    return one.join(middle.agg(((F.min("v") + F.max("v")) / 2).alias("median")), F.lit(True))


def crosstab(rows: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """A row for each `by`, a column of counts for each of the named kinds."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def outcomes(rows: DataFrame, outcome: str, by: str | None = None) -> DataFrame:
    """n and counts of success, partial and failure, overall or by category."""
    keys = [by] if by else []
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col(outcome) == o).alias(o) for o in ("success", "partial", "failure")])


def bucket(value: Column, edges: list[float]) -> Column:
    """Name of the half-open bin, from `<first` to `>=last`."""
    out = F.lit(f">={edges[-1]:g}")
    for low, high in reversed([(None, edges[0]), *zip(edges, edges[1:], strict=False)]):
        out = F.when(value < high, f"<{high:g}" if low is None else f"{low:g}-{high:g}").otherwise(out)
    return out


def tags(*rules: tuple[str, Column]) -> Column:
    """Sorted names of the rules that hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(held, name) for name, held in rules])))


def primary(found: Column, priority: list[str], default: str = "other") -> Column:
    """The first tag of the priority list that was found."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, priority)), lambda p: F.array_contains(found, p)), F.lit(0)), F.lit(default))


def top_values(rows: DataFrame, value: str, n: int) -> DataFrame:
    """The n most frequent values with their counts, ties by value."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(n)


def readiness(present: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted share, 0 to 100, of what is there."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + weight * F.coalesce(present[name].cast("double"), F.lit(0.0))
    return F.bround(100 * total / sum(weights.values()), 2)


def phrase_errors(rows: DataFrame, category: str, tokens, watched: list[str], least: int = 3) -> DataFrame:
    """category, phrase, n: 1- to 3-grams that at least `least` rows of a category hold; single words only if watched, watched ones always."""
    from corpusloom.functions.text import word_ngrams

    grams = rows.select(category, F.explode(F.array_distinct(word_ngrams(tokens))).alias("phrase"))
    counted = grams.groupBy(category, "phrase").agg(F.count("*").alias("n"))
    watch = F.col("phrase").isin(*watched) if watched else F.lit(False)
    return counted.where(watch | (F.contains("phrase", F.lit(" ")) & (F.col("n") >= least)))


def page_of(rows: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """The rows of a page (from 1) of an ordered table."""
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size)


def shares(rows: DataFrame, by: str) -> DataFrame:
    """by, n and share of all."""
    out = rows.groupBy(by).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
