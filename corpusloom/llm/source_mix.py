"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's target is its weight's share of all words, stopped at MOST_EPOCHS times its own words with the excess
reshared by weight. A source takes complete epochs of all its documents first. What is left of its target is sampled:
every document draws an exponential key scaled by its quality weight, documents are sorted by key within their source,
and sizes are prefix-summed to the budget; a document is taken when more than half of it lies within the budget.

The prefix sum of a source never runs in one task: keys fall into SLICES slices, none of which any weight gives more
than 1 / LEAST_WEIGHT times its even share, slices are summed before anything is ordered, and only in the one slice of each source that holds the budget are documents ordered one by
one. Keys come from a hash of the doc_id and a seed, so reruns agree.

A null text has size 0 and takes nothing. A null source is a source of its own and the last. Repeated rows are documents
of their own: equal keys are ordered by doc_id and size and share the boundary by order. Only doc_id, source and text
are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_BYTES, checkpointed, free_name, word_array

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SLICES = 4096
LEAST_WEIGHT = 0.25
SEED = "mix"


def quality_weight(text) -> F.Column:
    """Sampling weight of a document, 0.25 to 1: the share of its characters that are not symbols or digits."""
    text = F.coalesce(text, F.lit(""))
    odd = F.length(text) - F.length(F.translate(text, "0123456789#*$%&|<>!", ""))
    return F.greatest(F.lit(LEAST_WEIGHT), 1 - odd / F.greatest(F.length(text), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target from documents' source and size: one row a source, water-filled."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    # Sources by the level at which they stop: the first k stop if the others' level, after the first k are full, is no lower.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sources = sources.withColumns(
        {
            "full": F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0)),
            "spent": F.coalesce(F.sum("weight").over(upto), F.lit(0)),
            "total": F.sum("source_size").over(every),
            "weights": F.sum("weight").over(every),
        }
    )
    level = (F.col("total") - F.col("full")) / (F.col("weights") - F.col("spent"))
    stops = most * F.col("source_size") < level * F.col("weight")
    sources = sources.withColumns({"stops": stops, "level": level})
    final = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)
    return sources.select(
        "source", "source_size",
        F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * final["level"]).alias("target"),
    )


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED, slices: int = SLICES) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of documents (doc_id, source, text)."""
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10)
    uniform = (draw.cast("bigint") + 1) / F.lit(float(2**52 + 1))
    sizes = documents.select("doc_id", "source", F.size(word_array(F.col("text"))).cast("bigint").alias("size"), (-F.log(uniform) / quality_weight(F.col("text"))).alias("key"))
    # A key's slice: equal chances for the least weight; a larger weight w has w / LEAST_WEIGHT times the mean in the first slices.
    sizes = checkpointed(sizes.withColumn("slice", F.floor((1 - F.exp(-F.col("key") * LEAST_WEIGHT)) * slices).cast("int")))
    goals = targets(sizes, weights, most)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("bigint"))
    goals = goals.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    goals = checkpointed(goals)

    by_slice = sizes.groupBy("source", "slice").agg(F.sum("size").alias("held"))
    within = Window.partitionBy("source").orderBy("slice")
    by_slice = by_slice.withColumn("before", F.sum("held").over(within) - F.col("held"))
    same = by_slice["source"].eqNullSafe(goals["source"])
    edge = by_slice.join(goals, same).where("before < left and before + held >= left").select(by_slice["source"], F.col("slice").alias("edge"), "before")
    plan = goals.join(edge, goals["source"].eqNullSafe(edge["source"]), "left").select(goals["*"], "edge", "before").withColumnRenamed("source", "of")
    plan = checkpointed(plan)
    if plan.count() * 256 <= BROADCAST_BYTES:
        plan = F.broadcast(plan)
    rows = sizes.join(plan, sizes["source"].eqNullSafe(plan["of"]))

    plain = rows.where("edge is null or slice <> edge").withColumn("extra", (F.col("edge").isNotNull() & (F.col("slice") < F.col("edge"))).cast("bigint"))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    at_edge = rows.where("slice = edge").withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at_edge = at_edge.withColumn("extra", (F.col("upto") - F.col("size") / 2 < F.col("left")).cast("bigint")).drop("upto")
    out = plain.unionByName(at_edge).withColumn("copies", F.col("epochs") + F.col("extra"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(documents: DataFrame, **options) -> DataFrame:
    """documents that the mix takes, with size, copies (1 to MOST_EPOCHS) and taken; rows of one doc_id share the most copies."""
    name = free_name("mix_doc_id", documents)
    taken = mix(documents, **options).groupBy(F.col("doc_id").alias(name)).agg(F.max("size").alias("size"), F.max("copies").alias("copies"), F.max("taken").alias("taken"))
    taken = checkpointed(taken.where("copies > 0"))
    if taken.count() * 48 <= BROADCAST_BYTES:
        taken = F.broadcast(taken)
    clash = [c for c in documents.columns if c.lower() in ("size", "copies", "taken")]
    return documents.drop(*clash).join(taken, F.col("doc_id").eqNullSafe(F.col(name))).drop(name)
