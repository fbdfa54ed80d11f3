"""The evidence pack: high-confidence links as capability-tagged corpus records, balanced questions and capability counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of each relation: capability id, its name, the type of question and its templates; fixed values
CAPABILITIES = {
    "glosses_word": ("word_gloss", "Word meaning from Pozhippurai", "direct_lexical", "What does `{source}` mean in this Paadal according to the Pozhippurai?"),
    "explains_phrase": ("phrase_explanation", "Phrase explanation", "commentary_dependent", "How does the Pozhippurai explain the phrase `{source}`?"),
    "explains_line": ("line_explanation", "Line-level explanation", "commentary_dependent", "What is the commentary explanation for this Paadal line: `{source}`?"),
    "interprets_image": ("poetic_image_interpretation", "Poetic image and iconography interpretation", "poetic_imagery", "What does the poetic or iconographic image `{source}` mean?"),
    "describes_entity": ("entity_description", "Entity, deity, object, and place description", "entity_or_place", "What does the Pozhippurai say about `{source}`?"),
    "theological_explanation": ("theological_explanation", "Devotional or theological explanation", "theology_or_devotion", "What devotional or theological meaning is explained for `{source}`?"),
}
LEAST_QUESTIONS = 20


def _of(n: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in CAPABILITIES.items() for x in (k, v[n])]), F.col("relationship_type"))


def evidence_path() -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(
        F.lit("Thirumurai "), text("thirumurai_no"), F.lit(" > Pathigam "), text("pathigam_id"), F.lit(" > Paadal "), text("paadal_id"), F.lit(" > source["), text("source_start_char"), F.lit(":"),
        text("source_end_char"), F.lit("] > pozhippurai["), text("target_start_char"), F.lit(":"), text("target_end_char"), F.lit("]"),
    )


def evidence_rows(links: DataFrame, passages: DataFrame) -> DataFrame:
    """High links that need no review, with their passage's texts, capability and evidence path. passages: paadal_id, full_paadal_text, full_pozhippurai."""
    rows = links.where((F.col("confidence") == "high") & ~F.col("manual_review_required") & F.col("relationship_type").isin(*CAPABILITIES)).join(passages, "paadal_id", "left")
    texts = {c: F.coalesce(c, F.lit("")) for c in ("full_paadal_text", "full_pozhippurai")}
    return rows.withColumns(texts | {"capability_id": _of(0), "capability_name": _of(1), "question_type": _of(2), "evidence_path": evidence_path()})


def corpus(evidence: DataFrame) -> DataFrame:
    """record_id, chunk_id, chunk_type, chunk_text and citation_text of every evidence row."""
    record = F.concat(F.lit("evidence_rag_"), "link_id")
    text = F.concat(
        F.lit("Paadal span:\n"), "source_text", F.lit("\n\nPozhippurai explanation:\n"), "target_text", F.lit("\n\nFull Paadal:\n"), "full_paadal_text", F.lit("\n\nEvidence path:\n"), "evidence_path"
    )
    return evidence.withColumns({"record_id": record, "chunk_id": F.concat(record, F.lit("_chunk_001")), "chunk_type": F.lit("high_confidence_paadal_pozhippurai_evidence_path"), "chunk_text": text, "citation_text": F.col("evidence_path")})


def balanced(evidence: DataFrame, per_capability: int = LEAST_QUESTIONS) -> DataFrame:
    """Up to so many rows of each relation, the first by a hash of relation, passage and link, with their number nth."""
    key = F.sha2(F.concat_ws("|", F.lit("qa"), "relationship_type", "paadal_id", "link_id"), 256)
    order = Window.partitionBy("relationship_type").orderBy("_key", "link_id")
    return evidence.withColumn("_key", key).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_capability).drop("_key")


def questions(evidence: DataFrame, per_capability: int = LEAST_QUESTIONS) -> DataFrame:
    """question_id, question, answer outline and gold ids of the balanced rows, numbered by relation as listed and then by hash."""
    rows = balanced(evidence, per_capability)
    place = F.array_position(F.array(*map(F.lit, CAPABILITIES)), F.col("relationship_type"))
    counts = rows.groupBy(place.alias("place")).agg(F.count("*").alias("held"))
    before = counts.withColumn("before", F.sum("held").over(Window.orderBy("place")) - F.col("held")).select("place", "before")  # six rows at most
    rows = rows.withColumn("place", place).join(F.broadcast(before), "place")
    asked = F.replace(_of(3), F.lit("{source}"), F.col("source_text"))
    return rows.select(
        F.format_string("HC_QA_%03d", (F.col("before") + F.col("nth")).cast("int")).alias("question_id"), "capability_id", "question_type", asked.alias("question"), F.col("target_text").alias("gold_answer_outline"),
        F.col("link_id").alias("gold_link_id"), F.col("paadal_id").alias("gold_paadal_id"), F.col("relationship_type").alias("gold_relationship_type"), F.col("evidence_path").alias("gold_evidence_path"),
    )


def capabilities(evidence: DataFrame, least: int = LEAST_QUESTIONS) -> DataFrame:
    """capability_id, capability_name, relationship_type, evidence paths and whether they suffice, for all relations."""
    known = evidence.sparkSession.createDataFrame([(k, v[0], v[1], v[2]) for k, v in CAPABILITIES.items()], "relationship_type string, capability_id string, capability_name string, question_type string")
    counts = evidence.groupBy("relationship_type").agg(F.count("*").alias("paths"))
    rows = known.join(counts, "relationship_type", "left").withColumn("paths", F.coalesce("paths", F.lit(0)))
    return rows.withColumn("can_support_rag_now", F.col("paths") >= least)
