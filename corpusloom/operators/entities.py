"""Entity annotation from lexicons: mentions, overlap resolution, co-occurrence and evaluation.

A lexicon is a small table. Each task compiles it into one Aho-Corasick automaton, and texts are scanned once where they
are read, whatever the number of terms. Overlaps are resolved by windows, so a text with any number of mentions stays a
sorted run.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.generate import generated

_FOUND = "term string, entity_type string, canonical_id string, start_char int, end_char int"


def word_character(c: str) -> bool:
    """Letters, digits, the underscore and all of the Tamil block, whose marks are no letters."""
    return c.isalnum() or c == "_" or "\u0b80" <= c <= "\u0bff"


def _scanner(lexicon: list[tuple[str, str, str]], boundaries: bool, overlapping: bool):
    def make():
        by_term: dict[str, list[int]] = {}
        for n, (term, *_) in enumerate(lexicon):
            by_term.setdefault(term, []).append(n)
        automaton = ahocorasick.Automaton()
        for term, own in by_term.items():
            automaton.add_word(term, (term, own))
        if by_term:
            automaton.make_automaton()

        def find(text):
            done: dict[str, int] = {}
            for last, (term, own) in automaton.iter(text) if by_term and text else ():
                start, end = last + 1 - len(term), last + 1
                if not overlapping and start < done.get(term, 0):
                    continue
                if boundaries and (start and word_character(text[start - 1]) or end < len(text) and word_character(text[end])):
                    continue
                done[term] = end
                for n in own:
                    yield *lexicon[n], start, end

        return find

    return make


def mentions(rows: DataFrame, key: str, lexicon: list[tuple[str, str, str]], text: str = "text", boundaries: bool = True) -> DataFrame:
    """key, term, entity_type, canonical_id, start_char, end_char: occurrences of each term that don't overlap themselves.

    lexicon: (term, entity type, canonical id). boundaries: letters, digits and Tamil marks may not touch a match.
    """
    return generated(rows, [key], [text], _FOUND, _scanner(lexicon, boundaries, overlapping=False))


def pilot_mentions(rows: DataFrame, key: str, lexicon: list[tuple[str, str, str]], text: str = "text") -> DataFrame:
    """As mentions, but overlapping ones too and without boundaries; the entity's shorter ones within longer ones go."""
    return suppress_contained(generated(rows, [key], [text], _FOUND, _scanner(lexicon, boundaries=False, overlapping=True)), [key, "canonical_id"])


def suppress_contained(found: DataFrame, within: list[str]) -> DataFrame:
    """Without mentions that lie in an earlier or longer one of their partition.

    Sorted by start and descending end, a mention is contained if an earlier one has reached as far as its end: a running
    maximum decides what a greedy scan would.
    """
    order = Window.partitionBy(*within).orderBy("start_char", F.desc("end_char"), "term", "canonical_id" if "canonical_id" not in within else "term")
    reached = F.max("end_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_reached", reached).where("_reached is null or _reached < end_char").drop("_reached")


def overlap_pairs(found: DataFrame, key: str) -> DataFrame:
    """Pairs of mentions of different types in one text that share characters, each pair once.

    Mentions are first bucketed by the 64-character cells that they touch, so a join meets only neighbours.
    """
    cells = found.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_char") / 64), F.floor((F.col("end_char") - 1) / 64))))
    named = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("term", "entity_type", "start_char", "end_char")]
    left = cells.select(F.col(key), "cell", *named("a"))
    right = cells.select(F.col(key).alias("_key"), F.col("cell").alias("_cell"), *named("b"))
    on = (F.col(key) == F.col("_key")) & (F.col("cell") == F.col("_cell")) & (F.col("start_char_a") < F.col("end_char_b")) & (F.col("start_char_b") < F.col("end_char_a")) & (F.col("entity_type_a") < F.col("entity_type_b"))
    return left.join(right, on).drop("_key", "_cell", "cell").distinct()


def covering_parents(found: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Mentions that contain at least `least` strictly smaller ones."""
    named = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("term", "start_char", "end_char")]
    rows = found.select(key, "term", "start_char", "end_char").distinct()
    cells = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_char") / 64), F.floor((F.col("end_char") - 1) / 64))))
    big = cells.select(key, "cell", *named("a"))
    small = rows.select(F.col(key).alias("_key"), F.floor(F.col("start_char") / 64).alias("_cell"), *named("b"))
    inside = (F.col("start_char_a") <= F.col("start_char_b")) & (F.col("end_char_b") <= F.col("end_char_a")) & (F.col("end_char_a") - F.col("start_char_a") > F.col("end_char_b") - F.col("start_char_b"))
    held = big.join(small, (F.col(key) == F.col("_key")) & (F.col("cell") == F.col("_cell")) & inside)
    return held.groupBy(key, F.col("term_a").alias("term"), F.col("start_char_a").alias("start_char")).agg(F.count("*").alias("children")).where(F.col("children") >= least)


def cooccurrence(found: DataFrame, unit: str, entity: str = "canonical_id", least: int = 3) -> DataFrame:
    """source, target, evidence_count, confidence, example: pairs of distinct entities that share at least `least` units.

    A unit has at most as many entities as the lexicon, so its pairs are bounded.
    """
    distinct = found.select(unit, entity).distinct()
    pairs = distinct.select(unit, F.col(entity).alias("source")).join(distinct.select(F.col(unit).alias("_unit"), F.col(entity).alias("target")), (F.col(unit) == F.col("_unit")) & (F.col("source") < F.col("target")))
    out = pairs.groupBy("source", "target").agg(F.count("*").alias("evidence_count"), F.min(unit).alias("example"))
    return out.where(F.col("evidence_count") >= least).withColumn("confidence", F.least(F.lit(0.85), F.lit(0.45) + F.col("evidence_count") / 100))


def evaluate(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """true_positive, false_positive, false_negative, precision, recall, f1 by exact key."""
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(predicted.select(*keys).distinct().withColumn("p", F.lit(1)), keys, "full_outer")
    one = both.agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("true_positive"), F.count_if(F.col("g").isNull()).alias("false_positive"), F.count_if(F.col("p").isNull()).alias("false_negative"))
    share = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return one.withColumns({"precision": share(tp, fp), "recall": share(tp, fn), "f1": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)})


def context_supports(text, start, end, cues: list[str], radius: int = tx.CONTEXT_RADIUS) -> Column:
    """Whether one of the cues stands near a span; no cues support everything."""
    near = tx.window_of(text, start, end, radius)
    held = F.lit(not cues)
    for c in cues:
        held = held | F.contains(near, F.lit(c))
    return held


def reviewed(found: DataFrame, decision: Column) -> DataFrame:
    """Mentions with review_status and a clamped confidence by decision: reject goes, accept is at most .78 and at least .55, review at least .45."""
    rows = found.withColumn("decision", decision).where("decision is null or decision <> 'reject'")
    confidence = F.when(F.col("decision") == "accept", F.greatest(F.lit(0.55), F.least(F.lit(0.78), F.col("confidence")))).when(F.col("decision") == "review", F.greatest(F.lit(0.45), F.col("confidence"))).otherwise(F.col("confidence"))
    return rows.withColumns({"confidence": confidence, "review_status": F.coalesce("decision", F.lit("unreviewed"))}).drop("decision")


def ontology_violations(types: DataFrame, relations: DataFrame) -> DataFrame:
    """code, name: duplicate names, and domain or range members that are no type. relations: name, domain, range (arrays)."""
    twice = types.groupBy("name").count().where("count > 1").select(F.lit("duplicate_type").alias("code"), "name")
    members = relations.select("name", F.explode(F.array(F.struct(F.lit("unknown_domain").alias("code"), F.col("domain").alias("m")), F.struct(F.lit("unknown_range").alias("code"), F.col("range").alias("m")))).alias("e"))
    members = members.select("e.code", F.explode("e.m").alias("member"), "name")
    unknown = members.join(types.select(F.col("name").alias("_type")), F.col("member") == F.col("_type"), "left_anti").select("code", F.concat_ws(":", "name", "member").alias("name"))
    return twice.unionByName(unknown)
