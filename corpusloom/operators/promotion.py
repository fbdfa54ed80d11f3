"""Promotion of hardened links: anchors resolved by rules, phrase families, word senses, repairs of relations and the final gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import cues, linking

#: Families of relations; fixed values
FAMILIES = {
    "interprets_image": "image_family", "theological_explanation": "theology_family", "describes_entity": "entity_family",
    "glosses_word": "phrase_family", "explains_phrase": "phrase_family", "explains_line": "phrase_family",
}
#: Penalties that say a link has its order only, and those that no high link may have; fixed values
ORDER_ONLY = ("order_only_penalty", "order_only_support")
HIGH_BLOCKERS = ("order_only_penalty", "polysemy_without_context_penalty", "fragment_source_penalty")


@dataclass(frozen=True)
class PhraseFamily:
    name: str
    family: str
    source: tuple[str, ...]
    target: tuple[str, ...]


@dataclass(frozen=True)
class AnchorRule:
    """An anchor by its names; context cues make it safe, and any of the others rules it out."""

    canonical: str
    kind: str
    aliases: tuple[str, ...]
    relation: str
    bias: str
    context: tuple[str, ...] = ()
    against: tuple[str, ...] = ()


def family_of(relation: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair]), relation), F.lit("unknown_family"))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    held = F.lit(False)
    for w in words:
        held = held | F.contains(text, F.lit(w))
    return held


def matched_families(families: Sequence[PhraseFamily]) -> Column:
    """Names of families with a cue on each side, of the row's own family of relations or of any where that is unknown."""
    own = family_of(F.col("relationship_type"))
    each = [
        F.when((own.isin(x.family, "unknown_family")) & contains_any(F.col("source_text"), x.source) & contains_any(F.col("target_text"), x.target), F.lit(x.name)) for x in families
    ]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")


def paraphrase_score(matched: Column) -> Column:
    """0 without a family; else .24 + .16 each, up to .75, with shares of the learned and the anchor score."""
    base = F.least(F.lit(0.75), 0.24 + 0.16 * F.size(matched))
    more = F.least(F.lit(0.20), F.coalesce("learned_pattern_score", F.lit(0.0)) / 4) + F.least(F.lit(0.15), F.coalesce("anchor_resolver_score", F.lit(0.0)) / 5)
    return F.when(F.size(matched) == 0, 0.0).otherwise(F.bround(F.least(F.lit(1.0), base + more), 4))


def non_order_evidence(paraphrase: Column) -> Column:
    """Sum of all evidence that does not come from the order of lines."""
    parts = ("semantic_lexicon_score", "shared_entity_anchor_score", "ontology_relation_score", "relationship_cue_score", "gold_pattern_similarity", "anchor_resolver_score", "learned_pattern_score")
    return F.bround(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) + paraphrase, 4)


@dataclass(frozen=True)
class Sense:
    """A word that is safe if one of its context words stands near and unsafe if not; never: it can't be unsafe."""

    word: str
    context: tuple[str, ...]
    label: str = ""
    never: bool = False


def word_senses(senses: Sequence[Sense]) -> tuple[Column, Column]:
    """(note, score) of the words that need a context in either text: .45 if one has none, 1 if all have theirs or no word needs one."""
    text = F.concat_ws(" ", "source_text", "target_text")
    safe, unsafe = [], []
    for s in senses:
        there, near = F.contains(text, F.lit(s.word)), contains_any(text, s.context)
        safe.append(F.when(there & near, F.lit(s.label or s.word)))
        unsafe.append(F.lit(None).cast("string") if s.never else F.when(there & ~near, F.lit(s.word)))
    safe, unsafe = (F.array_compact(F.array(*x)) if x else F.array().cast("array<string>") for x in (safe, unsafe))
    note = F.when(F.size(unsafe) > 0, F.concat(F.lit("unsafe_or_context_weak:"), F.array_join(unsafe, "|"))).when(F.size(safe) > 0, F.concat(F.lit("safe:"), F.array_join(F.slice(safe, 1, 6), "|")))
    return F.coalesce(note, F.lit("not_polysemous_or_no_trigger")), F.when(F.size(unsafe) > 0, 0.45).otherwise(1.0)


def alias_match(column: str, alias: str) -> Column:
    """An alias in a prepared column without white space, also without the alias's case ending."""
    import re

    short = "".join(alias.split())
    bare = re.sub(cues.STEM_ENDINGS, "", short)
    held = F.contains(f"_{column}_c", F.lit(short))
    return held | F.contains(f"_{column}_c", F.lit(bare)) if len(bare) > 2 and bare != short else held


def anchor_hits(column: str, rules: Sequence[AnchorRule]) -> Column:
    """array of struct(canonical, kind, relation, bias, context): anchors that a prepared column names, none that the context rules out."""
    each = []
    for r in rules:
        named = F.lit(False)
        for a in r.aliases:
            named = named | alias_match(column, a)
        for w in r.against:
            named = named & ~alias_match(column, w)
        found = F.lit(0)
        for w in r.context:
            found = found + alias_match(column, w).cast("int")
        context = F.least(F.lit(1.0), found / min(2, len(r.context))) if r.context else F.lit(1.0)
        hit = F.struct(F.lit(r.canonical).alias("canonical"), F.lit(r.kind).alias("kind"), F.lit(r.relation).alias("relation"), F.lit(r.bias).alias("bias"), context.alias("context"))
        each.append(F.when(named & (context > 0), hit))
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<struct<canonical:string,kind:string,relation:string,bias:string,context:double>>")


def with_resolution(links: DataFrame, rules: Sequence[AnchorRule], pairs: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """links with matched_anchors, ontology_relations, the parts of anchor_resolver_score, missing_anchor_resolved and review_reason.

    Two hits agree if they are one anchor, a named pair of anchors (canonical, canonical, relation), or of one kind and the row's relation.
    """
    rows = cues.prepared(links, "source_text", "target_text")
    rows = rows.withColumns({"_a": anchor_hits("source_text", rules), "_b": anchor_hits("target_text", rules)})

    def joined(x, y):
        named = F.lit(None).cast("string")
        for one, two, relation in pairs:
            held = ((x["canonical"] == one) & (y["canonical"] == two)) | ((x["canonical"] == two) & (y["canonical"] == one))
            named = F.when(held, relation).otherwise(named)
        same = F.when(x["relation"] == y["relation"], x["relation"]).otherwise(F.concat(F.lit("shared_anchor("), x["canonical"], F.lit(")")))
        alike = (x["kind"] == y["kind"]) & ((F.col("relationship_type") == x["bias"]) | (F.col("relationship_type") == y["bias"]))
        return F.when(x["canonical"] == y["canonical"], same).otherwise(F.coalesce(named, F.when(alike, F.concat(F.lit("refers_to("), x["kind"], F.lit(")")))))

    met = F.flatten(F.transform("_a", lambda x: F.transform("_b", lambda y: F.struct(joined(x, y).alias("relation"), x["canonical"].alias("x"), y["canonical"].alias("y")))))
    rows = rows.withColumn("_met", F.filter(met, lambda m: m["relation"].isNotNull()))
    a, b, n = F.size("_a"), F.size("_b"), F.size("_a") + F.size("_b")
    both = F.concat("_a", "_b")
    relations = F.array_sort(F.array_distinct(F.col("_met")["relation"]))
    matched = F.array_sort(F.array_distinct(F.concat(F.col("_met")["x"], F.col("_met")["y"])))
    four = lambda x: F.bround(x, 4)
    alias = F.least(F.lit(1.0), n / 6)
    morphology = F.when((a > 0) & (b > 0), 0.6).otherwise(0.0)
    context = F.least(F.lit(1.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x["context"]) / F.greatest(F.lit(1), n))
    ontology = F.least(F.lit(1.0), 0.35 * F.size(relations))
    kinds = F.size(F.array_intersect(F.col("_a")["kind"], F.col("_b")["kind"]))
    family = F.least(F.lit(1.0), kinds / 2 + F.when(F.size(matched) > 0, 0.4).otherwise(0.0))
    safety = F.when(F.forall(both, lambda x: x["context"] >= 0.5), 1.0).otherwise(0.4)
    rows = rows.withColumns(
        {
            "matched_anchors": matched, "ontology_relations": relations, "anchor_alias_score": four(alias), "anchor_morphology_score": four(morphology), "anchor_context_score": four(context),
            "anchor_relation_score": four(ontology), "anchor_family_score": four(family), "polysemy_safety_score": four(safety),
            "anchor_resolver_score": four(0.25 * alias + 0.15 * morphology + 0.20 * context + 0.25 * ontology + 0.15 * family), "_n": F.struct(a.alias("a"), b.alias("b")),
        }
    )
    score = F.col("anchor_resolver_score")
    resolved = (score >= 0.55) & (F.col("anchor_relation_score") >= 0.30) & (F.col("polysemy_safety_score") >= 0.70) & (F.size("matched_anchors") > 0)
    why = (
        F.when(resolved, "").when(score >= 0.45, "near_threshold_or_context_weak").when((F.col("_n.a") > 0) & (F.col("_n.b") == 0), "anchor_found_only_on_source")
        .when((F.col("_n.b") > 0) & (F.col("_n.a") == 0), "anchor_found_only_on_target").when(F.col("polysemy_safety_score") < 0.70, "polysemy_context_unsafe").otherwise("no_shared_ontology_anchor")
    )
    return cues.unprepared(rows.withColumns({"missing_anchor_resolved": resolved, "review_reason": why}).drop("_a", "_b", "_met", "_n"), "source_text", "target_text")


def missing_anchor_fixed(rows: DataFrame, biases: Column, blocking: Sequence[str]) -> DataFrame:
    """rows (with resolution) without the penalty that is resolved: a medium link whose relation an anchor speaks for goes up to high, a low one to medium.

    biases: relations that the row's anchors speak for. blocking: flags that keep a link from high.
    """
    name = "missing_entity_anchor_penalty"
    had = F.array_contains("penalties_applied", name)
    fixed = had & F.col("missing_anchor_resolved")
    held_back = F.arrays_overlap(F.concat("penalties_applied", "critical_warnings"), F.array(*map(F.lit, blocking)))
    up = fixed & (F.col("confidence") == "medium") & ~held_back & (F.col("anchor_resolver_score") >= 0.75) & F.array_contains(biases, F.col("relationship_type"))
    half = fixed & ~up & (F.col("confidence") == "low")
    score = F.when(up, F.greatest(F.col("score"), F.lit(0.83))).when(half, F.greatest(F.col("score"), F.lit(0.58))).otherwise(F.col("score"))
    decision = F.when(up, "PROMOTE_TO_HIGH").when(half, "PROMOTE_TO_MEDIUM").when(fixed, F.when(F.col("manual_review_required"), "KEEP_REVIEW").otherwise("KEEP_LOW")).when(had, "KEEP_REVIEW").otherwise("")
    new = {
        "promotion_decision": decision, "score": F.bround(score, 4), "penalties_applied": F.when(fixed, F.array_remove("penalties_applied", name)).otherwise(F.col("penalties_applied")),
        "manual_review_required": F.when(up, False).when(half, True).otherwise(F.col("manual_review_required")), "confidence": F.when(up, "high").when(half, "medium").otherwise(F.col("confidence")),
    }
    return rows.withColumns(new)


def repaired_relation(matched: Column, image: Sequence[str], theology: Sequence[str], places: Sequence[str]) -> Column:
    """struct(relation, reason): unknown relations become phrases; image, devotion and place words with a matching family correct weaker ones."""
    now, joined = F.col("relationship_type"), F.concat_ws(" ", "source_text", "target_text")
    picture = F.exists(matched, lambda m: m.endswith("_image"))
    pious = F.arrays_overlap(matched, F.array(F.lit("worship_action_result"), F.lit("grace_result")))
    out = lambda relation, reason: F.struct(relation.alias("relation"), F.lit(reason).alias("reason"))
    return (
        F.when(~now.isin(*FAMILIES), out(F.lit("explains_phrase"), "invalid_relationship_defaulted_to_phrase"))
        .when(contains_any(joined, image) & now.isin("explains_phrase", "glosses_word") & picture, out(F.lit("interprets_image"), "iconography_or_myth_cue_repaired_to_image"))
        .when(contains_any(joined, theology) & now.isin("explains_phrase", "describes_entity") & pious, out(F.lit("theological_explanation"), "devotional_result_cue_repaired_to_theology"))
        .when(contains_any(joined, places) & (now == "interprets_image") & F.array_contains(matched, "deity_thalam_entity"), out(F.lit("describes_entity"), "thalam_identity_cue_repaired_to_entity"))
        .otherwise(out(now, ""))
    )


def promoted(rows: DataFrame, prior_high: Column) -> DataFrame:
    """rows through the gates: what was high stays; what only order supports is held; clear links with much evidence rise.

    rows: paraphrase_score, non_order_evidence, issues, and the columns of `linking.v5_score`. Adds v5_score, promotion_decision and the gate.
    """
    order_bound = F.arrays_overlap("penalties_applied", F.array(*map(F.lit, ORDER_ONLY)))
    gate = (F.col("non_order_evidence") >= 0.85) & ~order_bound
    raw = linking.v5_score(family_of(F.col("relationship_type")), F.col("best_second_margin"), F.col("issues"))
    rows = rows.withColumns({"_gate": gate, "_order": order_bound, "v5_score": raw})
    was, score, evidence, phrase = F.col("confidence"), F.col("v5_score"), F.col("non_order_evidence"), F.col("paraphrase_score")
    keep = prior_high | (was == "high")
    clear = (F.size("penalties_applied") == 0) & (F.size("critical_warnings") == 0)
    high = clear & (score >= 0.82) & (evidence >= 1.65) & (phrase >= 0.45) & (F.col("polysemy_safety_score") >= 0.70)
    medium = (was == "low") & (score >= 0.58) & (evidence >= 1.20) & (phrase >= 0.35) & ~F.col("_order")
    decision = (
        F.when(keep, "UNCHANGED").when(~F.col("_gate"), F.when(F.col("_order"), "REJECTED_ORDER_ONLY").otherwise("UNCHANGED")).when(high, "PROMOTE_HIGH").when(medium, "PROMOTE_MEDIUM")
        .when(~clear, "KEEP_REVIEW").otherwise("UNCHANGED")
    )
    level = F.when(keep, "high").when(~F.col("_gate"), F.when(was == "low", "low").otherwise("medium")).when(high, "high").when(medium, "medium").otherwise(was)
    review = F.when(keep, F.size("critical_warnings") > 0).when(~F.col("_gate"), True).when(high, False).when(medium | ~clear, True).otherwise(score < 0.82)
    unsafe = ~keep & (level == "high") & F.arrays_overlap("penalties_applied", F.array(*map(F.lit, HIGH_BLOCKERS)))
    final = F.when(keep, F.greatest(score, F.col("score"), F.lit(0.82))).otherwise(score)
    return rows.withColumns(
        {
            "promotion_decision": F.when(unsafe, "REJECTED_UNSAFE").otherwise(decision), "manual_review_required": unsafe | review, "order_only_evidence_gate": F.when(F.col("_gate"), "pass").otherwise("block"),
            "score": F.bround(final, 4), "confidence": F.when(unsafe, F.when(was == "medium", "medium").otherwise("low")).otherwise(level),
        }
    ).drop("_gate", "_order")


def block_resolution(issues_before: Column, issues_after: Column, decision: Column) -> Column:
    """What became of a link that a pattern speaks for and a blocker held."""
    asked = F.array_contains(issues_before, "high_pattern_but_blocked") | (F.coalesce("learned_pattern_score", F.lit(0.0)) >= 0.42)
    has = lambda name: F.array_contains(issues_after, name)
    return (
        F.when(~asked, "").when(decision == "PROMOTE_HIGH", "RESOLVED_PROMOTE_HIGH").when(decision == "PROMOTE_MEDIUM", "RESOLVED_PROMOTE_MEDIUM")
        .when(has("broad_or_unsplit_target"), "BLOCKED_BROAD_TARGET").when(has("ambiguous_span"), "BLOCKED_AMBIGUOUS_MARGIN").when(has("polysemy_context"), "BLOCKED_POLYSEMY")
        .when(has("missing_anchor"), "BLOCKED_NO_ONTOLOGY_RELATION").when(has("relation_granularity_mismatch"), "BLOCKED_RELATION_MISMATCH").otherwise("KEEP_REVIEW")
    )


def suggested_fix(issues: Column) -> Column:
    has = lambda name: F.array_contains(issues, name)
    return (
        F.when(has("missing_anchor"), "Add/validate ontology anchor alias or relation cue.").when(has("ambiguous_span"), "Review top target candidates and neighbour alignment.")
        .when(has("broad_or_unsplit_target"), "Mark the minimal commentary clause that explains the source span.").when(has("polysemy_context"), "Add local context rule or negative example for the ambiguous word.")
        .when(has("weak_semantic_signal"), "Add paraphrase pair to Tamil literary lexicon.").otherwise("Review confidence calibration and relationship type.")
    )


# --- mining -------------------------------------------------------------------------------------------------------------


def is_example() -> Column:
    """High, reviewed and linked rows, from which patterns are learned."""
    return (F.col("confidence") == "high") & ~F.col("manual_review_required") & (F.col("relationship_type") != "unlinked") & (F.coalesce("target_text", F.lit("")) != "") & (F.coalesce("source_text", F.lit("")) != "")


def paraphrase_lexicon(rows: DataFrame, families: Sequence[PhraseFamily], least: int = 2, most: int = 4, examples: int = 8) -> DataFrame:
    """source_phrase, target_phrase, relationship_family, support_count, confidence, example_link_ids of pairs of cues that examples of a family hold together."""
    held = lambda c, words: F.slice(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col(c), w)), 1, most)
    own = family_of(F.col("relationship_type"))
    each = F.array(*[F.struct(F.lit(x.family).alias("relationship_family"), held("source_text", x.source).alias("s"), held("target_text", x.target).alias("t")) for x in families])
    rows = rows.where(is_example()).select("link_id", F.inline(F.filter(each, lambda x: x["relationship_family"] == own)))
    rows = rows.select("link_id", "relationship_family", F.explode("s").alias("source_phrase"), "t").select("link_id", "relationship_family", "source_phrase", F.explode("t").alias("target_phrase"))
    keys = ["source_phrase", "target_phrase", "relationship_family"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("support_count")).where(F.col("support_count") >= least)
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("link_id"))).where(F.col("nth") <= examples).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("link_id")), "|").alias("example_link_ids"))
    n = F.col("support_count")
    return counts.join(first, keys).withColumn("confidence", F.when(n >= 12, "high").when(n >= 5, "medium").otherwise("low"))


def pattern_groups(rows: DataFrame, families: Sequence[PhraseFamily]) -> DataFrame:
    """pattern_group, relationship_type, support_count, negative_count, precision, promotion_threshold of families among high and weak links."""
    matched = matched_families(families)
    rows = rows.withColumns({"_matched": matched, "_score": paraphrase_score(matched)}).select("relationship_type", "confidence", "manual_review_required", "_score", F.explode("_matched").alias("pattern_group"))
    good = (F.col("confidence") == "high") & ~F.col("manual_review_required")
    bad = ~good & F.col("confidence").isin("low", "medium") & (F.col("_score") < 0.5)
    out = rows.groupBy("pattern_group", "relationship_type").agg(F.count_if(good).alias("support_count"), F.count_if(bad).alias("negative_count")).where("support_count > 0")
    precision = F.bround(F.col("support_count") / (F.col("support_count") + F.col("negative_count")), 4)
    return out.withColumn("precision", precision).withColumn("promotion_threshold", F.when(F.col("precision") >= 0.9, 0.82).otherwise(0.86))


def length_ratio(source: Column, target: Column) -> Column:
    """Tokens of the target to those of the source."""
    return F.size(tx.verse_tokens(target)) / F.greatest(F.lit(1), F.size(tx.verse_tokens(source)))
