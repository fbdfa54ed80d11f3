"""Budgeted context packages and citations from ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def context_package(results: DataFrame, records: DataFrame, fields: list[str], top_k: int = 5, max_chars: int = 6000) -> DataFrame:
    """query_id, context_id, rank, record_id, the fields, content_char_count, content_truncated.

    Results lose unknown records and all but the best of each record, then fill the budget in rank order: the field in
    which it runs out is cut and later ones are empty. Contexts that would begin beyond the budget go. Everything is running sums.
    """
    of = Window.partitionBy("query_id")
    rows = results.join(records.select("record_id", *[F.coalesce(c, F.lit("")).alias(c) for c in fields]), "record_id")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", "record_id").orderBy("rank", "chunk_id"))).where("_nth = 1")
    order = of.orderBy("rank", "record_id")
    size = sum((F.length(c) for c in fields), F.lit(0))
    rows = rows.withColumns({"_no": F.row_number().over(order), "_before": F.sum(size).over(order) - size}).where((F.col("_no") <= top_k) & (F.col("_before") < max_chars))
    at, cut = F.col("_before"), {}
    for c in fields:
        cut[c] = F.substring(F.col(c), F.lit(1), F.greatest(F.lit(0), F.least(F.length(c), max_chars - at)).cast("int"))
        at = at + F.length(c)
    used = F.least(size, max_chars - F.col("_before"))
    out = rows.select("query_id", F.format_string("ctx_%03d", "_no").alias("context_id"), "rank", "record_id", "chunk_id", *[cut[c].alias(c) for c in fields], used.cast("bigint").alias("content_char_count"), (used < size).alias("content_truncated"))
    return out


def citations(contexts: DataFrame, source: list[str]) -> DataFrame:
    """citation_id (by query and rank), and the columns of its source."""
    order = Window.partitionBy("query_id").orderBy("rank", "record_id")
    return contexts.select("query_id", F.format_string("cit_%03d", F.row_number().over(order)).alias("citation_id"), "rank", "record_id", *source)


def citation_groups(cited: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted citation ids of each group of keys; a query has at most top_k of them."""
    return cited.groupBy("query_id", *keys).agg(F.array_sort(F.collect_list("citation_id")).alias("citation_ids"), F.count("*").alias("n"))


def package_errors(contexts: DataFrame) -> DataFrame:
    """query_id, error: ids that don't run on, and records or chunks that come up twice."""
    order = Window.partitionBy("query_id").orderBy("rank", "record_id")
    ids = contexts.withColumn("_due", F.format_string("ctx_%03d", F.row_number().over(order))).where("context_id <> _due").select("query_id", F.lit("context ids don't run on").alias("error"))
    twice = contexts.groupBy("query_id", "record_id").count().where("count > 1").select("query_id", F.lit("record twice").alias("error"))
    chunk = contexts.groupBy("query_id", "chunk_id").count().where("count > 1").select("query_id", F.lit("chunk twice").alias("error"))
    return ids.unionByName(twice).unionByName(chunk)
