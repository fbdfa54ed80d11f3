"""Hardening of links: evidence features from cue packs, penalties, calibrated scores, reranked targets, sequence and blockers.

Links have link_id, source_text, target_text, target_field, relationship_type, confidence, score, method, diagnostic_note,
score_margin and manual_review_required. Everything is expressions within a row, but for the sequence scores, which are
windows over the links of one passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.generate import generated
from corpusloom.operators import cues
from corpusloom.operators.cues import Pack
from corpusloom.operators.linking import anchor_score, granularity_score

#: A link's texts, and both as one.
S, T, J = "source_text", "target_text", "joined_text"
#: Notes that tell of links that only their order supports, and notes of rival targets; fixed values
ORDER_NOTES = ("mainly supported by poem/commentary order", "share little surface vocabulary")
RIVAL_NOTE = "best target is close"
FIELD_PREFERENCE = {"pozhppurai": 1.0, "kurippurai": 0.85}
RELATION_EVIDENCE = ("semantic_lexicon_score", "ontology_relation_score", "relationship_cue_score", "shared_entity_anchor_score")
#: Weights of a candidate's signal when a target is chosen anew; fixed values
RERANK_WEIGHTS = {"semantic_lexicon_score": 2.0, "ontology_relation_score": 2.0, "shared_entity_anchor_score": 1.5, "relationship_cue_score": 1.0, "surface_token_overlap": 1.0, "char_ngram_overlap": 0.5, "target_granularity_score": 0.2}
FEATURES = (
    "surface_token_overlap", "char_ngram_overlap", "semantic_lexicon_score", "morphology_stem_score", "shared_entity_anchor_score", "ontology_relation_score",
    "relationship_cue_score", "sequence_consistency_score", "neighbor_anchor_score", "gold_pattern_similarity", "target_granularity_score", "field_preference_score",
)


def is_linked() -> Column:
    """Whether a row links two texts at all."""
    return (F.col("relationship_type") != "unlinked") & (F.col("confidence") != "no_link") & (F.coalesce(T, F.lit("")) != "") & (F.coalesce(S, F.lit("")) != "")


def token_overlap() -> Column:
    return tx.jaccard(F.array_distinct(f"_{S}_t"), F.array_distinct(f"_{T}_t"))


def ngram_overlap(n: int = 3) -> Column:
    """Set similarity of the compact texts' n-grams; 0 where a text is shorter than n."""
    short = (F.length(f"_{S}_c") < n) | (F.length(f"_{T}_c") < n)
    return F.when(short, 0.0).otherwise(tx.jaccard(tx.char_ngrams(F.col(f"_{S}_c"), n), tx.char_ngrams(F.col(f"_{T}_c"), n)))


def relation_cue_score(pack: Pack) -> Column:
    """A quarter for each cue of the row's relation that stands in either text or across the two, at most 1."""
    out = F.lit(0.0)
    joined, joined_c = F.concat_ws(" ", f"_{S}", f"_{T}"), F.concat(f"_{S}_c", f"_{T}_c")
    for relation, words in pack.relation_cues.items():
        found = F.lit(0)
        for cue in words:
            found = found + (F.contains(joined, F.lit(cue)) | F.contains(joined_c, F.lit("".join(cue.split())))).cast("int")
        out = F.when(F.col("relationship_type") == relation, F.least(F.lit(1.0), found / 4)).otherwise(out)
    return out


def gold_similarity(overlap: Column) -> Column:
    """How like a gold link a row is by where it comes from, its confidence and its overlap."""
    return (
        F.when(F.col("method").startswith("v4_gold"), 1.0).when(F.contains("diagnostic_note", F.lit("Focused QA rule matched")), 0.9)
        .when((F.col("confidence") == "high") & (F.col("score") >= 0.75), 0.75).when(overlap >= 0.35, 0.35).otherwise(0.0)
    )


def field_preference() -> Column:
    out = F.lit(0.5)
    for name, value in FIELD_PREFERENCE.items():
        out = F.when(F.col("target_field") == name, value).otherwise(out)
    return out


def with_features(links: DataFrame, pack: Pack) -> DataFrame:
    """links with the FEATURES (sequence ones 0), rule_ids_matched and shared_anchors; prepared texts stay for what follows."""
    rows = cues.prepared(links, S, T)
    relation = F.col("relationship_type")
    lexicon, by_lexicon = cues.rule_score(pack.lexicon, S, T, relation)
    morphology, by_morphology = cues.rule_score(pack.morphology, S, T, None)
    ontology, by_ontology = cues.rule_score(pack.ontology, S, T, relation)
    rows = rows.withColumns({"_a": cues.entity_anchors(S, pack.expansions), "_b": cues.entity_anchors(T, pack.expansions), "_overlap": token_overlap()})
    four = lambda x: F.bround(x, 4)
    shared = F.array_sort(F.array_intersect("_a", "_b"))
    family = lambda c: F.array_distinct(F.transform(c, lambda v: F.substring_index(v, ".", 1)))
    return rows.withColumns(
        {
            "surface_token_overlap": four(F.col("_overlap")), "char_ngram_overlap": four(ngram_overlap()), "semantic_lexicon_score": four(lexicon),
            "morphology_stem_score": four(morphology), "shared_entity_anchor_score": four(anchor_score(F.col("_a"), F.col("_b"))), "ontology_relation_score": four(ontology),
            "relationship_cue_score": four(relation_cue_score(pack)), "sequence_consistency_score": F.lit(0.0), "neighbor_anchor_score": F.lit(0.0),
            "gold_pattern_similarity": four(gold_similarity(F.col("_overlap"))),
            "target_granularity_score": four(granularity_score(F.size(f"_{S}_t"), F.size(f"_{T}_t"), relation)), "field_preference_score": four(field_preference()),
            "rule_ids_matched": F.concat(by_lexicon, by_morphology, by_ontology),
            "shared_anchors": F.when(F.size(shared) > 0, shared).otherwise(F.array_sort(F.array_intersect(family(F.col("_a")), family(F.col("_b"))))),
        }
    ).drop("_a", "_b", "_overlap")


def target_too_broad() -> Column:
    return (F.col("relationship_type") != "explains_line") & (F.size(f"_{T}_t") / F.greatest(F.lit(1), F.size(f"_{S}_t")) > 3.0)


def polysemy_without_context(pack: Pack) -> Column:
    held = F.lit(False)
    for term in pack.polysemous:
        held = held | cues.present(S, term)
    return held & (F.col("ontology_relation_score") + F.col("relationship_cue_score") + F.col("shared_entity_anchor_score") < 0.25)


def order_only() -> Column:
    support = sum((F.col(c) for c in ("semantic_lexicon_score", "morphology_stem_score", "shared_entity_anchor_score", "ontology_relation_score", "relationship_cue_score", "neighbor_anchor_score")), F.lit(0.0))
    noted = F.lit(False)
    for note in ORDER_NOTES:
        noted = noted | F.contains("diagnostic_note", F.lit(note))
    return (support < 0.2) & noted


def with_penalties(rows: DataFrame, pack: Pack, ambiguous_below: float = 0.08, review_below: float = 0.05) -> DataFrame:
    """rows (with features) with penalties_applied and critical_warnings."""
    margin = F.coalesce("score_margin", F.lit(1.0))
    rival = F.contains("diagnostic_note", F.lit(RIVAL_NOTE)) | ((F.col("confidence") == "low") & (margin < review_below))
    close = rival & (margin < ambiguous_below)
    unanchored = (F.col("shared_entity_anchor_score") == 0) & (F.col("ontology_relation_score") == 0)
    alone = order_only()
    names = F.array(
        F.when(alone, "order_only_penalty"), F.when(close, "ambiguous_margin_penalty"), F.when(unanchored, "missing_entity_anchor_penalty"),
        F.when(target_too_broad(), "target_too_broad_penalty"), F.when(polysemy_without_context(pack), "polysemy_without_context_penalty"),
    )
    critical = F.array(F.when(alone, "order_only_support"), F.when(close & (margin < review_below), "best_second_margin_below_review_threshold"))
    return rows.withColumns({"penalties_applied": F.array_compact(names), "critical_warnings": F.array_compact(critical)})


def hardened(rows: DataFrame, weights: dict[str, float], penalty_values: dict[str, float]) -> DataFrame:
    """rows (with features and penalties) with their hardened score and confidence; rows that link nothing are no_link at 0."""
    weighted = sum((F.lit(w) * F.col(n) for n, w in weights.items()), F.lit(0.0))
    lost = sum((F.when(F.array_contains("penalties_applied", n), v).otherwise(0.0) for n, v in penalty_values.items()), F.lit(0.0))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(0.99), 0.45 * F.col("score") + 1.9 * weighted + 0.04 - lost))
    support = sum((F.col(c) for c in RELATION_EVIDENCE), F.lit(0.0))
    clear = F.size("critical_warnings") == 0
    level = F.when((raw >= 0.78) & clear & (support >= 0.35), F.when(F.array_contains("penalties_applied", "ambiguous_margin_penalty"), "medium").otherwise("high"))
    level = F.coalesce(level, F.when(raw >= 0.5, "medium").otherwise("low"))
    gold = (F.col("confidence") == "high") & (F.col("gold_pattern_similarity") >= 0.75) & clear
    linked = is_linked()
    return rows.withColumns(
        {
            "score": F.when(~linked, 0.0).otherwise(F.bround(F.when(gold, F.greatest(raw, F.lit(0.82))).otherwise(raw), 4)),
            "confidence": F.when(~linked, "no_link").when(gold, "high").otherwise(level),
            "penalties_applied": F.when(~linked, F.array(F.lit("empty_pozhippurai_penalty"))).otherwise(F.col("penalties_applied")),
            "critical_warnings": F.when(~linked, F.array(F.lit("no_usable_target"))).otherwise(F.col("critical_warnings")),
        }
    )


def with_sequence(rows: DataFrame, group: str, start: str = "source_start_char", target: str = "target_start_char", key: str = "link_id") -> DataFrame:
    """rows with sequence_consistency_score, neighbor_anchor_score and sequence_alignment_method by their neighbours in a passage.

    A passage runs in reverse if, of three or more placed links, more steps go back than forth. A link agrees with a neighbour that
    lies on its side in that direction; it has a firm neighbourhood if it lies between both.
    """
    order, whole = Window.partitionBy(group).orderBy(start, key), Window.partitionBy(group)
    at = F.col(target)
    last = F.last(target, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_last": last, "_before": F.lag(target).over(order), "_after": F.lead(target).over(order)})
    forth = F.count_if(at.isNotNull() & F.col("_last").isNotNull() & (at >= F.col("_last"))).over(whole)
    back = F.count_if(at.isNotNull() & F.col("_last").isNotNull() & (at < F.col("_last"))).over(whole)
    rows = rows.withColumn("_reverse", (F.count(target).over(whole) >= 3) & (back > forth))
    before = F.when(F.col("_reverse"), at <= F.col("_before")).otherwise(at >= F.col("_before"))
    after = F.when(F.col("_reverse"), at >= F.col("_after")).otherwise(at <= F.col("_after"))
    asked = F.col("_before").isNotNull().cast("int") + F.col("_after").isNotNull().cast("int")
    agreed = F.coalesce(before.cast("int"), F.lit(0)) + F.coalesce(after.cast("int"), F.lit(0))
    sequence = F.when(asked > 0, agreed / asked).otherwise(0.5)
    between = at.between(F.least("_before", "_after"), F.greatest("_before", "_after"))
    near = F.when(asked == 2, F.when(between, 1.0).otherwise(0.25)).when(asked == 1, sequence * 0.6).otherwise(0.0)
    method = F.when(at.isNull(), "rule_or_unavailable").when(F.col("_reverse"), "reverse_order_alignment").otherwise("global_sequence_assignment")
    out = {"sequence_consistency_score": F.when(at.isNull(), 0.0).otherwise(F.bround(sequence, 4)), "neighbor_anchor_score": F.when(at.isNull(), 0.0).otherwise(F.bround(near, 4)), "sequence_alignment_method": method}
    return rows.withColumns(out).drop("_last", "_before", "_after", "_reverse")


def _clauses():
    import re

    from corpusloom.functions.find import clean_phrase

    clause = re.compile(r"[^,;.!?।\n]+")

    def find(text, centre, window):
        low, high = (0, len(text or "")) if centre is None else (max(0, centre - window), min(len(text or ""), centre + window))
        for m in clause.finditer(text or ""):
            own = clean_phrase(m[0])
            if m.end() >= low and m.start() <= high and re.search(r"[஀-௿A-Za-z0-9]", own):
                at = text.find(own, m.start(), m.end())
                if at >= 0:
                    yield at, at + len(own), own

    return find


def target_candidates(rows: DataFrame, keep: list[str], text: str, centre: str, window: int = 500) -> DataFrame:
    """keep, candidate_start, candidate_end, candidate: clauses of a text within window characters of a centre (null: all)."""
    asked = rows.withColumn("_window", F.lit(window))
    return generated(asked, keep, [text, centre, "_window"], "candidate_start bigint, candidate_end bigint, candidate string", _clauses)


def should_rerank() -> Column:
    noted = F.contains("diagnostic_note", F.lit(ORDER_NOTES[0])) | F.contains("diagnostic_note", F.lit(RIVAL_NOTE))
    return is_linked() & ~F.col("method").startswith("v4_gold") & (F.col("confidence") == "low") & noted


def reranked(links: DataFrame, full_text: str, pack: Pack) -> DataFrame:
    """links with weak targets replaced by a clause of the full text whose signal beats the present features' sum by .35.

    Only weak links are given candidates, which never leave their row's key; of equal signals the first clause wins.
    """
    weak = links.where(should_rerank())
    columns = [c for c in links.columns if c not in (T, full_text)]
    now = with_features(weak, pack).select("link_id", sum((F.col(f) for f in FEATURES), F.lit(0.0)).alias("_signal"), F.size(f"_{S}_t").alias("_words"), F.col(T).alias("_present"))
    found = target_candidates(weak, columns, full_text, "target_start_char").withColumnRenamed("candidate", T)
    found = with_features(found, pack)
    signal = sum((w * F.col(n) for n, w in RERANK_WEIGHTS.items()), F.lit(0.0))
    found = found.select("link_id", signal.alias("_best"), "candidate_start", "candidate_end", F.col(T).alias("_candidate"), F.size(f"_{T}_t").alias("_size")).join(now, "link_id")
    found = found.where(F.col("_size") <= F.greatest(F.lit(18), 6 * F.col("_words")))
    best = found.groupBy("link_id").agg(F.max_by(F.struct("_best", "candidate_start", "candidate_end", "_candidate", "_signal", "_present"), F.struct("_best", -F.col("candidate_start"))).alias("b"))
    best = best.select("link_id", "b.*").where((F.col("_candidate") != F.col("_present")) & (F.col("_best") >= F.col("_signal") + 0.35))
    rows = links.join(best.select("link_id", "candidate_start", "candidate_end", "_candidate"), "link_id", "left")
    new = F.col("_candidate").isNotNull()
    renamed = F.concat(F.lit("ppl_v4h_"), tx.stable_hash(F.col("link_id"), F.col(S), F.col("target_field"), F.col("candidate_start"), F.col("candidate_end")))
    return rows.withColumns(
        {
            "link_id": F.when(new, renamed).otherwise(F.col("link_id")), T: F.coalesce("_candidate", T), "target_start_char": F.coalesce("candidate_start", "target_start_char"),
            "target_end_char": F.coalesce("candidate_end", "target_end_char"), "method": F.when(new, "v4_hardened_global_sequence_rerank").otherwise(F.col("method")),
        }
    ).drop("candidate_start", "candidate_end", "_candidate")


def harden(links: DataFrame, group: str, pack: Pack, weights: dict[str, float], penalty_values: dict[str, float], full_text: str | None = None) -> DataFrame:
    """All steps: weak targets chosen anew (where full_text names the passage's column), features, sequence, penalties, score and confidence."""
    rows = reranked(links, full_text, pack) if full_text else links
    rows = with_penalties(with_sequence(with_features(rows, pack), group), pack)
    return cues.unprepared(hardened(rows, weights, penalty_values), S, T)


# --- blockers: reviewed patterns and anchors that hold a link back or bring it on ---------------------------------------

#: Words whose sense needs a context, and sources that are mere fragments; fixed values
CONTEXT_WORDS = ("மதி", "அரவு", "அடி")
FRAGMENTS = ("நகரே", "இலரே", "அல்லனே")
EVIDENCE = ("semantic_lexicon_score", "expanded_entity_anchor_score", "ontology_relation_score", "relationship_cue_score", "gold_pattern_similarity")


def with_blocker_features(links: DataFrame, pack: Pack) -> DataFrame:
    """links with the features that reviewed anchors, patterns and pairs give; prepared texts stay."""
    rows = cues.prepared(links.withColumn(J, F.concat_ws(" ", S, T)), S, T, J)
    rows = rows.withColumns({"anchor_ids": cues.resolved_anchors(pack.anchors, S, T, J), "pattern_ids": cues.matching_patterns(pack.patterns, S, T)})
    a, p = F.size("anchor_ids"), F.size("pattern_ids")
    morphology = F.lit(False)
    for anchor in pack.anchors:
        morphology = morphology | (cues.any_stemmed(S, anchor.aliases) & cues.stemmed(T, anchor.canonical))
    relation = F.lit(0)
    for x in pack.patterns:
        relation = relation + ((F.col("relationship_type") == x.relation) & cues.all_groups(J, x.target)).cast("int")
    squeezed = lambda pairs: [("".join(s.split()), "".join(t.split())) for s, t in pairs]
    pair = F.struct(F.col(f"_{S}_c").alias("s"), F.col(f"_{T}_c").alias("t"))
    listed = lambda pairs: pair.isin(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")) for s, t in squeezed(pairs)]) if pairs else F.lit(False)
    one = lambda x: F.least(F.lit(1.0), x)
    four = lambda x: F.bround(x, 4)
    rows = rows.withColumns(
        {
            "surface_token_overlap": four(token_overlap()), "char_ngram_overlap": four(ngram_overlap()), "semantic_lexicon_score": four(one(0.22 * p + 0.10 * a)),
            "morphology_stem_score": F.when(morphology, 0.35).otherwise(0.0), "shared_entity_anchor_score": four(one(0.24 * a)), "expanded_entity_anchor_score": four(one(0.28 * a + 0.10 * p)),
            "ontology_relation_score": four(one(0.30 * p)), "relationship_cue_score": four(one(relation / 2)), "sequence_consistency_score": F.lit(0.0), "neighbor_anchor_score": F.lit(0.0),
            "gold_pattern_similarity": F.when(listed(pack.recovered), 1.0).when(listed(pack.split_high), 0.95).otherwise(0.0),
            "target_granularity_score": four(granularity_score(F.size(f"_{S}_t"), F.size(f"_{T}_t"), F.col("relationship_type"))),
            "best_second_margin": four(F.coalesce("score_margin", F.lit(1.0))),
        }
    )
    found = sum((F.col(c) for c in (*EVIDENCE, "shared_entity_anchor_score")), F.lit(0.0))
    inherited = F.col("confidence").isin("high", "medium") & (F.col("score") >= 0.45)
    return rows.withColumn("order_only_evidence_gate", F.when((found >= 0.3) | inherited, 1.0).otherwise(0.0))


def with_blocker_penalties(rows: DataFrame, duplicate: Column | None = None) -> DataFrame:
    weak = F.col("confidence").isin("low", "no_link", "")
    note = F.lower("diagnostic_note")
    ordered = F.contains(note, F.lit("order")) | F.contains(note, F.lit("do-not-promote")) | F.contains(note, F.lit("wrong target"))
    close = weak & (F.col("best_second_margin") < 0.05)
    alone = (F.col("order_only_evidence_gate") == 0) & (weak | ordered)
    fragment = F.col(f"_{S}_c").isin(*FRAGMENTS)
    names = F.array(
        F.when(target_too_broad(), "target_too_broad_penalty"), F.when(weak & (F.col("expanded_entity_anchor_score") == 0) & (F.col("ontology_relation_score") == 0), "missing_entity_anchor_penalty"),
        F.when(close, "ambiguous_margin_penalty"), F.when(alone, "order_only_penalty"),
        F.when(weak & cues.any_stemmed(S, CONTEXT_WORDS) & (F.col("ontology_relation_score") == 0), "polysemy_without_context_penalty"),
        F.when(duplicate if duplicate is not None else F.lit(False), "duplicate_link_penalty"), F.when(fragment, "fragment_source_penalty"),
    )
    critical = F.array(F.when(close, "best_second_margin_below_review_threshold"), F.when(alone, "order_only_support"), F.when(fragment, "fragment_source"))
    return rows.withColumns({"penalties_applied": F.array_compact(names), "critical_warnings": F.array_compact(critical)})


def blocked(rows: DataFrame) -> DataFrame:
    """rows (with blocker features and penalties) with score, confidence and review flag: fragments are no links, gold pairs have a floor, and what was high stays so unless only order supports it."""
    base, was = F.col("score"), F.col("confidence")
    evidence = sum((F.col(c) for c in EVIDENCE), F.lit(0.0))
    warned = lambda name: F.array_contains("critical_warnings", name)
    lost = 0.06 * F.size("penalties_applied") + F.when(F.array_contains("penalties_applied", "target_too_broad_penalty"), 0.05).otherwise(0.0)
    raw = F.greatest(F.lit(0.0), F.least(F.lit(0.99), 0.78 * base + 0.14 * evidence + 0.08 * F.col("target_granularity_score") - lost))
    fine = F.col("target_granularity_score") >= 0.6
    gold = F.col("gold_pattern_similarity") >= 0.95
    nothing = warned("fragment_source") | (was == "no_link")
    alone = warned("order_only_support")
    score = F.when(gold, F.greatest(raw, F.when(fine, 0.86).otherwise(0.72))).otherwise(raw)
    known = F.when(was.isin("no_link", "low", "medium", "high"), was).otherwise("low")
    level = (
        F.when(gold, F.when(fine, "high").otherwise("medium")).when((score >= 0.74) & (evidence >= 0.45) & ~alone, "high")
        .when((score >= 0.42) & ((evidence >= 0.2) | was.isin("high", "medium")), "medium").otherwise(known)
    )
    stay = (was == "high") & ~alone
    rise = ~stay & (was == "medium") & (level == "low") & ~alone
    score = F.when(stay, F.greatest(score, base)).when(rise, F.greatest(score, F.least(base, F.lit(0.74)))).otherwise(score)
    level = F.when(stay, "high").when(rise, "medium").otherwise(level)
    review = F.col("manual_review_required") | (level == "low") | (F.size("critical_warnings") > 0)
    fallen = alone & (level == "high")
    return rows.withColumns(
        {
            "score": F.when(nothing, F.bround(raw, 4)).otherwise(F.bround(score, 4)), "confidence": F.when(nothing, "no_link").when(fallen, "low").otherwise(level),
            "manual_review_required": nothing | fallen | review,
        }
    )


# --- the gates of promotion ---------------------------------------------------------------------------------------------


def review_priority(blocked_by: Column) -> Column:
    p = F.col("learned_pattern_score")
    return (
        F.when((F.col("confidence") == "medium") & (p >= 0.42) & ~blocked_by, "accept_candidate").when(p >= 0.6, "review_strong_pattern")
        .when(p >= 0.42, "review_pattern_with_blocker").when(p >= 0.3, "review_possible_pattern").otherwise("low_priority")
    )


def key_of(*arrays: str) -> Column:
    """Sorted names of each array, one after the other, joined by commas; none where there are none."""
    each = F.concat(*[F.array_sort(F.coalesce(a, F.array().cast("array<string>"))) for a in arrays])
    return F.when(F.size(each) > 0, F.array_join(each, ",")).otherwise("none")


def has_blocking_warning(blocking: tuple[str, ...]) -> Column:
    return (F.size("critical_warnings") > 0) | F.arrays_overlap("penalties_applied", F.array(*map(F.lit, blocking)))
