"""Links from lines to passages of their explanation: candidates, features, scores, confidence, penalties, promotion, repair.

Everything is expressions over a table of links; rule packs are small tables or constants.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import spans

#: Weights of a candidate's features; fixed values
CANDIDATE_WEIGHTS = {"token_score": 0.22, "char_score": 0.15, "synonym_score": 0.13, "entity_score": 0.20, "containment_score": 0.15, "order_score": 0.20}
#: Least scores that are strong evidence; fixed values
STRONG = {"token_score": 0.18, "synonym_score": 0.5, "entity_score": 0.5, "containment_score": 0.45}
CONFIDENCE = ("high", "medium", "low", "none", "no_link")
#: Terms of the auto-hardened score, its bonuses by family of relation, and its penalties by issue; fixed values
V5_WEIGHTS = {"score": 0.30, "learned_pattern_score": 0.18, "paraphrase_score": 0.16, "anchor_resolver_score": 0.14, "polysemy_safety_score": 0.12, "ontology_relation_score": 0.08, "relationship_cue_score": 0.06}
V5_FAMILY = {"image_family": 0.05, "theology_family": 0.04, "entity_family": 0.03, "phrase_family": 0.02}
V5_ISSUES = {"broad_or_unsplit_target": 0.10, "ambiguous_span": 0.10, "missing_anchor": 0.08, "order_only": 0.20}


def _clamp(x: Column, high: float = 0.99) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(high), x))


def order_score(line_no: Column, lines: Column, first: Column, last: Column, segments: Column) -> Column:
    """1 less the distance of the line's and the window's relative places; .6 where there is only one of either."""
    place = (line_no - 1) / F.greatest(F.lit(1), lines - 1)
    middle = ((first + last) / 2 - 1) / F.greatest(F.lit(1), segments - 1)
    return F.when((segments == 1) | (lines <= 1), 0.6).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(place - middle)))


def candidate_features(records: DataFrame, key: str, source: str, target: str, most: int = 3) -> DataFrame:
    """Every line of a record's source with every window of clauses of its target, and their similarity features.

    Lines and windows meet within their record only. Synonym and entity scores are 0 unless they are joined in later.
    """
    lines = spans.line_spans(records, key, source).select(key, "line_no", F.col("line_text").alias("source_text"), F.col("start_char").alias("source_start"), F.col("end_char").alias("source_end"))
    lines = lines.withColumn("lines", F.count("*").over(Window.partitionBy(key)))
    clauses = spans.segment_spans(records, key, target)
    counts = clauses.withColumn("segments", F.count("*").over(Window.partitionBy(key))).select(key, "segments").distinct()
    windows = spans.segment_windows(clauses, key, most).join(counts, key).join(records.select(key, F.col(target).alias("_whole")), key)
    windows = windows.withColumn("target_text", F.substring("_whole", (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))).drop("_whole")
    # Sets are made once for a line and once for a window, not for each pair.
    lines = lines.withColumns({"_a": F.array_distinct(tx.search_tokens(F.col("source_text"))), "_c": tx.char_ngrams(F.col("source_text"))})
    windows = windows.withColumns({"_b": F.array_distinct(tx.search_tokens(F.col("target_text"))), "_d": tx.char_ngrams(F.col("target_text"))})
    rows = lines.join(windows, key)
    rows = rows.withColumns(
        {
            "token_score": tx.jaccard(F.col("_a"), F.col("_b")),
            "char_score": tx.jaccard(F.col("_c"), F.col("_d")),
            "containment_score": tx.containment(F.col("source_text"), F.col("target_text"), F.col("_a")),
            "order_score": order_score(F.col("line_no"), F.col("lines"), F.col("segment_no"), F.col("segment_end_no"), F.col("segments")),
            "synonym_score": F.lit(0.0),
            "entity_score": F.lit(0.0),
        }
    )
    return rows.drop("_a", "_b", "_c", "_d").withColumn("score", candidate_score())


def candidate_score() -> Column:
    total = F.lit(0.0)
    for name, weight in CANDIDATE_WEIGHTS.items():
        total = total + weight * F.col(name)
    return F.bround(total, 4)


def ranked(candidates: DataFrame, *line: str) -> DataFrame:
    """Candidates with rank, candidate_count and score_margin to the second best of their line; smaller windows win ties."""
    of = Window.partitionBy(*line)
    order = of.orderBy(F.desc("score"), "window_size", "segment_no")
    rows = candidates.withColumns({"rank": F.row_number().over(order), "candidate_count": F.count("*").over(of), "best": F.max("score").over(of)})
    second = F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))).over(of), F.lit(0.0))
    return rows.withColumn("score_margin", F.bround(F.col("best") - second, 4)).drop("best")


def confidence(has_target: Column | None = None) -> Column:
    """high, medium, low by score and strong evidence; none without a text to link to."""
    strong = F.lit(False)
    for name, least in STRONG.items():
        strong = strong | (F.col(name) >= least)
    out = F.when((F.col("score") >= 0.52) & strong, "high").when((F.col("score") >= 0.32) | ((F.col("score") >= 0.27) & strong), "medium").otherwise("low")
    return out if has_target is None else F.when(has_target, out).otherwise("none")


def diagnostic(level: Column, bonus: Column | None = None) -> Column:
    """Label of a link by its confidence and, for weak ones, by what they lack: order alone, a margin (or an alignment's bonus), vocabulary, a shared entity."""
    surface = F.greatest(*[F.col(c) for c in ("token_score", "char_score", "synonym_score", "entity_score", "containment_score")])
    bonus = F.lit(0.0) if bonus is None else F.coalesce(bonus, F.lit(0.0))
    return (
        F.when(level == "none", "missing_pozhippurai").when(level == "high", "strong_link").when(level == "medium", "usable_review")
        .when((surface == 0) & (F.col("order_score") > 0), "order_only_weak_match").when((F.col("score_margin") < 0.03) & (bonus < 0.08), "ambiguous_multiple_targets")
        .when((F.col("token_score") == 0) & (F.col("synonym_score") == 0) & (F.col("containment_score") < 0.15), "low_lexical_overlap")
        .when(F.col("entity_score") == 0, "no_shared_entity_anchor").otherwise("weak_similarity")
    )


#: What a diagnostic label says; fixed values
PROBLEM_REASONS = {
    "strong_link": "High-confidence link with strong lexical/entity/containment evidence.",
    "usable_review": "Medium-confidence link; likely useful but should be sampled before scholarly use.",
    "missing_pozhippurai": "The commentary row has no pozhppurai text.",
    "order_only_weak_match": "The selected target is mainly supported by poem/commentary order, with little lexical or entity evidence.",
    "ambiguous_multiple_targets": "The best target is close to the second-best target, so several pozhppurai spans may be plausible.",
    "low_lexical_overlap": "The paadal line and selected pozhppurai target share little surface vocabulary.",
    "no_shared_entity_anchor": "No accepted Entity v2 anchor overlaps both source and target spans.",
    "weak_similarity": "The link has only weak combined similarity evidence.",
}


def problem_reason(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PROBLEM_REASONS.items() for x in pair]), label), F.lit("Unclassified diagnostic category."))


#: Words that show a relation, and entity types whose mention describes an entity; fixed values
THEOLOGY_HINTS = ("அருள்", "தொழு", "தொழுது", "வணங்கு", "பணி", "பணிந்து", "தவம்", "வினை", "பதி", "பாசம்", "மலம்", "ஞானம்", "முத்தி")
IMAGE_HINTS = ("மதி", "பிறை", "கங்கை", "சடை", "நீறு", "விடை", "பாம்பு", "அரவு", "கொன்றை", "மழு", "கடல்", "புனல்", "மலர்")
DESCRIBING_TYPES = ("DEITY", "BODY_PART", "SACRED_OBJECT", "TEMPLE")


def relation_of(joined: Column, votes: Column, types: Column, tokens: Column, theology: tuple[str, ...] = THEOLOGY_HINTS, image: tuple[str, ...] = IMAGE_HINTS) -> Column:
    """Relation of a line to its target: the seed patterns' vote, else by hints, entity types and the line's number of tokens.

    votes: the winner of the seed patterns' votes, null without any. types: entity types that the line mentions.
    """
    held = lambda words: reduce(lambda a, b: a | b, [F.contains(joined, F.lit(w)) for w in words], F.lit(False))
    ruled = (
        F.when(held(theology), "theological_explanation").when(F.arrays_overlap(types, F.array(*map(F.lit, DESCRIBING_TYPES))), "describes_entity").when(held(image), "interprets_image")
        .when(tokens <= 3, "glosses_word").when(tokens >= 7, "explains_line").otherwise("explains_phrase")
    )
    return F.coalesce(votes, ruled)


def seed_votes(rows: DataFrame, key: str, tokens: Column, patterns: DataFrame) -> DataFrame:
    """key, vote: the relation with most votes of a row's tokens, ties by the token that came first. patterns: token, relation, n."""
    own = rows.select(key, F.posexplode(tokens).alias("at", "token")).join(F.broadcast(patterns) if patterns.count() < 100_000 else patterns, "token")
    votes = own.groupBy(key, "relation").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    return votes.groupBy(key).agg(F.max_by("relation", F.struct("n", -F.col("at"))).alias("vote"))


def best_links(candidates: DataFrame, *line: str) -> DataFrame:
    """The best window of each line with its confidence and diagnostic label."""
    rows = ranked(candidates, *line).where("rank = 1").withColumn("confidence", confidence())
    return rows.withColumn("diagnostic", diagnostic(F.col("confidence")))


def anchor_score(a: Column, b: Column) -> Column:
    """.35 + .15 for each shared anchor; else .2 + .08 for each shared family (what is before the first `.`), up to .45."""
    shared = F.size(F.array_intersect(a, b))
    family = lambda x: F.array_distinct(F.transform(x, lambda v: F.substring_index(v, ".", 1)))
    families = F.size(F.array_intersect(family(a), family(b)))
    return F.when(shared > 0, F.least(F.lit(1.0), 0.35 + 0.15 * shared)).when(families > 0, F.least(F.lit(0.45), 0.2 + 0.08 * families)).otherwise(0.0)


def granularity_score(source_tokens: Column, target_tokens: Column, relation: Column) -> Column:
    """How well a target's size fits: by the ratio of token counts, and more leniently where a whole line is explained."""
    ratio = F.greatest(F.lit(1), target_tokens) / F.greatest(F.lit(1), source_tokens)
    return F.when(relation == "explains_line", F.when(ratio <= 8, 0.8).otherwise(0.5)).when(ratio <= 2.5, 1.0).when(ratio <= 4, 0.6).otherwise(0.25)


def v5_score(family: Column, margin: Column, issues: Column) -> Column:
    """Weighted terms, with bonuses by margin and family and penalties by issue."""
    raw = F.when(margin >= 0.12, 0.12).when(margin >= 0.05, 0.06).otherwise(0.0)
    for name, weight in V5_WEIGHTS.items():
        raw = raw + weight * F.coalesce(F.col(name), F.lit(1.0 if name == "polysemy_safety_score" else 0.0))
    for name, bonus in V5_FAMILY.items():
        raw = raw + F.when(family == name, bonus).otherwise(0.0)
    for name, penalty in V5_ISSUES.items():
        raw = raw - F.when(F.array_contains(issues, name), penalty).otherwise(0.0)
    return F.bround(_clamp(raw), 4)


def promoted(rows: DataFrame, blocked: Column, high: float = 0.78, medium: float = 0.5) -> DataFrame:
    """Links with confidence, score and review flag after promotion by learned patterns (learned_pattern_score, evidence array)."""
    p, n = F.col("learned_pattern_score"), F.size("evidence")
    was = F.col("confidence")
    firm = F.arrays_overlap("evidence", F.array(F.lit("rule"), F.lit("anchor")))
    step = (
        F.when(blocked | was.isin("no_link", "none"), "").when((was == "medium") & (p >= 0.42) & (n >= 2), "medium_to_high")
        .when((was == "low") & (p >= 0.6) & firm, "low_to_high").when((was == "low") & (p >= 0.38) & (n >= 2), "low_to_medium").otherwise("")
    )
    rows = rows.withColumn("promotion", step)
    to = F.col("promotion")
    score = (
        F.when(to == "medium_to_high", F.greatest(F.col("score"), high + F.least(F.lit(0.12), p / 5))).when(to == "low_to_high", F.greatest(F.col("score"), F.lit(high)))
        .when(to == "low_to_medium", F.greatest(F.col("score"), medium + F.least(F.lit(0.1), p / 6))).otherwise(F.col("score"))
    )
    level = F.when(to.endswith("_high"), "high").when(to == "low_to_medium", "medium").otherwise(was)
    review = F.when(to.endswith("_high"), False).when(to == "low_to_medium", True).otherwise(F.col("manual_review_required"))
    return rows.withColumns({"score": F.bround(F.least(F.lit(0.99), score), 4), "confidence": level, "manual_review_required": review})


def confidence_order(column: str = "confidence") -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col(column)), F.lit(0)), F.lit(9))


def dedupe(links: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """The best link of each key by confidence, then score."""
    order = Window.partitionBy(*keys).orderBy(confidence_order(), F.desc("score"), tie)
    return links.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def repaired_spans(links: DataFrame, parents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Links with their target's offsets at its first occurrence in the parent; null where it has none."""
    rows = links.join(parents.select(key, F.col(text).alias("_text")), key, "left")
    at = F.instr(F.col("_text"), F.col("target_text")) - 1
    return rows.withColumns({"target_start": F.when(at >= 0, at), "target_end": F.when(at >= 0, at + F.length("target_text"))}).drop("_text")


def summary(links: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n: counts by each of several columns in one pass."""
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for d in dimensions])
    return links.select(F.inline(each)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def combined(*tables: DataFrame, keys: list[str]) -> DataFrame:
    """Links of several sources, the first source winning each key."""
    out = None
    for place, own in enumerate(tables):
        own = own.withColumn("_place", F.lit(place))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_place", F.desc("score"))
    return out.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth", "_place")


def evidence_path(row_id: str = "link_id") -> Column:
    """A link as one line of text with both ends' offsets."""
    return F.format_string("%s: [%d,%d) -> [%d,%d) %s", F.col(row_id).cast("string"), "source_start", "source_end", "start_char", "end_char", "confidence")
