"""Deterministic samples and best-of-key choices; every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def hash_sample(rows: DataFrame, key: str, n: int, by: list[str] | None = None, salt: str = "") -> DataFrame:
    """The n rows (of each group) with the smallest SHA-256 of their key; without groups a top-n, not a full sort."""
    rows = rows.withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256))
    if not by:
        return rows.orderBy("_h", key).limit(n).drop("_h")
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("_h", key))).where(F.col("_nth") <= n).drop("_h", "_nth")


def spread_sample(rows: DataFrame, order: str, n: int, by: list[str]) -> DataFrame:
    """n rows of each group at evenly spaced positions round(i * (N - 1) / (n - 1)), halves to even; all of a smaller group."""
    w = Window.partitionBy(*by)
    rows = rows.withColumns({"_at": F.row_number().over(w.orderBy(order)) - 1, "_all": F.count("*").over(w)})
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_all") - 1) / F.lit(max(n - 1, 1)), 0).cast("int"))
    return rows.where((F.col("_all") <= n) | F.array_contains(places, F.col("_at"))).drop("_at", "_all")


def quota_sample(rows: DataFrame, key: str, quotas: list[tuple[str, Column, int]], limit: int) -> DataFrame:
    """Rows taken by quotas (reason, predicate, n) in turn, a row by its first reason, limit in all; by hash within a quota."""
    reason = F.coalesce(*[F.when(p, F.lit(i)) for i, (_, p, _) in enumerate(quotas)])
    rows = rows.withColumns({"_reason": reason, "_h": F.sha2(F.col(key).cast("string"), 256)}).where("_reason is not null")
    order = Window.partitionBy("_reason").orderBy("_h", key)
    most = F.element_at(F.array(*[F.lit(n) for *_, n in quotas]), F.col("_reason") + 1)
    rows = rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most)
    names = F.element_at(F.array(*[F.lit(name) for name, *_ in quotas]), F.col("_reason") + 1)
    return rows.withColumn("sample_reason", names).orderBy("_reason", "_h", key).limit(limit).drop("_reason", "_h", "_nth")


def first_per_group(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")
