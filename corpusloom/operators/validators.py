"""Validation of stores and files as rows (code, key): embeddings, annotations, relationships between them, candidate stores, outputs; and golden queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.cleaning import substring_matches

#: Fields that an annotation or a relationship must have, and types of spans; fixed values
SPAN_FIELDS = ("annotation_id", "type", "label", "text", "review_status")
RELATION_FIELDS = ("annotation_id", "type", "source", "target", "relationship_type", "review_status")


def _codes(rows: DataFrame, key: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    each = F.array_compact(F.array(*[F.when(held, code) for code, held in rules]))
    return rows.select(F.explode(each).alias("code"), key.cast("string").alias("key"))


def _blank(name: str) -> Column:
    return tx.missing(F.col(name).cast("string")).isNull()


def _twice(rows: DataFrame, key: str, code: str) -> DataFrame:
    return rows.where(~_blank(key)).groupBy(key).count().where("count > 1").select(F.lit(code).alias("code"), F.col(key).cast("string").alias("key"))


def embedding_errors(rows: DataFrame, dimension: int, chunk: str = "chunk_id", parent: str = "parent_record_id", vector: str = "embedding") -> DataFrame:
    """Vectors without ids, of another dimension, without length or with a component that is no number, and ids that repeat."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))
    zero = F.forall(vector, lambda x: x == 0)
    found = _codes(rows, F.col(chunk), [("missing_id", _blank(chunk) | _blank(parent)), ("dimension_mismatch", F.size(vector) != dimension), ("not_a_number", odd), ("zero_length", ~odd & zero)])
    return found.unionByName(_twice(rows, chunk, "duplicate_chunk_id"))


def annotation_errors(annotations: DataFrame, records: DataFrame, span_types: list[str]) -> DataFrame:
    """What is wrong with annotations (record_id, the fields of a span or a relationship, start, end) of records (record_id, record_text)."""
    rows = annotations.join(records.select("record_id", "record_text"), "record_id", "left")
    key, text = F.concat_ws(":", "record_id", "annotation_id"), F.coalesce("record_text", F.lit(""))
    relation, span = F.col("type") == "relationship", F.col("type").isin(*span_types)
    numbers = F.col("start").isNotNull() & F.col("end").isNotNull()
    inside = numbers & (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length(text))
    rules = [("unknown_record", F.col("record_text").isNull()), ("invalid_type", ~F.coalesce(relation | span, F.lit(False))), ("missing_offsets", span & ~numbers), ("out_of_range", span & numbers & ~inside)]
    rules += [("text_mismatch", span & inside & ~substring_matches(text, F.col("text"), F.col("start"), F.col("end")))]
    rules += [(f"missing_{f}", span & _blank(f)) for f in SPAN_FIELDS if f != "type"] + [(f"missing_{f}", relation & _blank(f)) for f in RELATION_FIELDS if f not in ("type", "annotation_id", "review_status")]
    found = _codes(rows, key, rules)
    known = annotations.select(F.col("record_id").alias("_r"), F.col("annotation_id").alias("_a")).distinct()
    ends = annotations.where(F.col("type") == "relationship").select("record_id", "annotation_id", F.explode(F.array(F.struct(F.lit("unknown_source").alias("code"), F.col("source").alias("e")), F.struct(F.lit("unknown_target").alias("code"), F.col("target").alias("e")))).alias("x"))
    lost = ends.where("coalesce(x.e, '') <> ''").join(known, (F.col("record_id") == F.col("_r")) & (F.col("x.e") == F.col("_a")), "left_anti")
    twice = annotations.groupBy("record_id", "annotation_id").count().where("count > 1").select(F.lit("duplicate_annotation_id").alias("code"), F.concat_ws(":", "record_id", "annotation_id").alias("key"))
    return found.unionByName(lost.select("x.code", F.concat_ws(":", "record_id", "annotation_id").alias("key"))).unionByName(twice)


def candidate_errors(rows: DataFrame, status: str = "placeholder_seed", evidence: str = "placeholder_only") -> DataFrame:
    """Candidates of a store that holds placeholders only: other states, a confidence, or evidence that they claim."""
    return _codes(
        rows, F.col("candidate_id"),
        [("wrong_status", ~F.col("status").eqNullSafe(F.lit(status))), ("has_confidence", ~F.col("confidence").eqNullSafe(F.lit(0.0))), ("claims_evidence", ~F.col("source_record_id").eqNullSafe(F.lit(evidence)))],
    )


def output_errors(source: DataFrame, enriched: DataFrame, chunks: DataFrame, song: str = "song_no") -> DataFrame:
    """Differences between a corpus and what was made of it: songs lost or added, ids that repeat, records without chunks, chunks without text or parent."""
    a, b = source.select(song).distinct(), enriched.select(song).distinct()
    diff = lambda x, y, code: x.join(y, song, "left_anti").select(F.lit(code).alias("code"), F.col(song).cast("string").alias("key"))
    parents = chunks.select(F.col("parent_record_id").alias("record_id")).distinct()
    bare = enriched.join(parents, "record_id", "left_anti").select(F.lit("record_without_chunks").alias("code"), F.col("record_id").alias("key"))
    stray = chunks.join(enriched.select(F.col("record_id").alias("parent_record_id")), "parent_record_id", "left_anti").select(F.lit("chunk_without_record").alias("code"), F.col("chunk_id").alias("key"))
    empty = chunks.where(_blank("chunk_text")).select(F.lit("empty_chunk").alias("code"), F.col("chunk_id").alias("key"))
    parts = [diff(a, b, "lost_song"), diff(b, a, "added_song"), _twice(enriched, "record_id", "duplicate_record_id"), _twice(chunks, "chunk_id", "duplicate_chunk_id"), bare, stray, empty]
    return reduce(DataFrame.unionByName, parts)


def golden_queries(records: DataFrame, specs: list[tuple[str, str, str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(queries, expected): query_id, query_text, query_type, expected_min_results, and the record ids that each query must find.

    specs: (query id, text, type, which records); the records are looked at once for all queries.
    """
    each = F.array_compact(F.array(*[F.when(held, name) for name, _, _, held in specs]))
    expected = records.select(F.explode(each).alias("query_id"), "record_id").distinct()
    asked = records.sparkSession.createDataFrame([s[:3] for s in specs], "query_id string, query_text string, query_type string")
    counts = expected.groupBy("query_id").agg(F.count("*").alias("n"))
    return asked.join(counts, "query_id", "left").select("query_id", "query_text", "query_type", F.least(F.lit(1), F.coalesce("n", F.lit(0))).cast("int").alias("expected_min_results")), expected


def expected_chunks(expected: DataFrame, chunks: DataFrame, chunk_type: str | None = None) -> DataFrame:
    """query_id, chunk_id of all chunks (of a type) of the expected records."""
    rows = chunks if chunk_type is None else chunks.where(F.col("chunk_type") == chunk_type)
    return expected.join(rows.select(F.col("parent_record_id").alias("record_id"), "chunk_id"), "record_id").select("query_id", "chunk_id")
