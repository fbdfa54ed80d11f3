"""Hardening, learned patterns, cleaning and attribution on cases that say what the rules are for."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import benchmarks, cleaning, goldlinks, hardening, linking, promotion
from corpusloom.operators.cues import CueRule, Expansion, Pack, stem_forms

PACK = Pack(
    lexicon=(CueRule("LEX_IMAGE", ("புனல்",), ("கங்கை",), 0.21, "interprets_image"),), ontology=(CueRule("ONTO_HAIR", ("சடை",), ("சடைமுடி|சடை",), 0.17, "interprets_image"),),
    expansions=(Expansion("BODY_PART", "DIVINE_BODY", "நீலகண்டம்", ("நீலமாமிடற்று", "கண்டத்தினை")), Expansion("SACRED_PLACE", "THALAM", "ஆலவாய்", ("ஆலவாயிலான்",))),
    relation_cues={"interprets_image": ("சடை", "கங்கை", "முடி", "பிறை")}, polysemous=("மதி", "அடி"),
)
WEIGHTS = {"semantic_lexicon_score": 0.2, "ontology_relation_score": 0.2, "relationship_cue_score": 0.15, "shared_entity_anchor_score": 0.1, "target_granularity_score": 0.05}
PENALTIES = {"order_only_penalty": 0.2, "ambiguous_margin_penalty": 0.1, "missing_entity_anchor_penalty": 0.05, "target_too_broad_penalty": 0.08, "polysemy_without_context_penalty": 0.06}
ROW = "link_id string, p string, source_text string, target_text string, target_field string, relationship_type string, confidence string, score double, method string, diagnostic_note string, score_margin double, manual_review_required boolean, source_start_char bigint, source_end_char bigint, target_start_char bigint, target_end_char bigint"
ORDER, RIVAL = "The selected target is mainly supported by poem/commentary order, with little lexical or entity evidence.", "The best target is close to the second-best target, so several pozhppurai spans may be plausible."


def link(name, source, target, relation="interprets_image", level="low", score=0.22, note="x", margin=0.5, start=0, at=0, p="p1"):
    return (name, p, source, target, "pozhppurai", relation, level, score, "fixture", note, margin, level == "low", start, start + len(source), at, None if at is None else at + len(target))


@pytest.fixture(scope="module")
def hardened(spark):
    rows = [
        link("gap", "சடை ஆர் புனல்", "சடைமுடியில் கங்கையைத் தரித்தவனும்"), link("order", "அடி ஒன்று", "சம்பந்தமில்லா விளக்கம்", "explains_phrase", score=0.7, note=ORDER, start=20, at=40, p="p2"),
        link("anchor", "நீலமாமிடற்று ஆலவாயிலான்", "நீலநிறம் பொருந்திய கண்டத்தினை உடைய திரு ஆலவாய் இறைவனை", "describes_entity", start=40, at=80), link("rival", "பிறை முடிமேல்", "வெண்பிறையைச் சூடி", margin=0.01, note=RIVAL, start=60, at=None),
        link("empty", "பாடல்", "", "unlinked", "no_link", start=80),
    ]
    out = hardening.harden(spark.createDataFrame(rows, ROW), "p", PACK, WEIGHTS, PENALTIES)
    return {r.link_id: r for r in out.collect()}


def test_semantic_cues_close_a_gap_in_vocabulary(hardened):
    r = hardened["gap"]
    assert r.semantic_lexicon_score == 0.26 and r.ontology_relation_score == 0.22 and r.relationship_cue_score == 0.75 and r.rule_ids_matched == ["LEX_IMAGE", "ONTO_HAIR"]
    assert r.score > 0.22 and r.confidence in ("medium", "low")


def test_order_alone_makes_no_high_link(hardened):
    r = hardened["order"]
    assert r.confidence != "high" and "order_only_penalty" in r.penalties_applied and r.critical_warnings == ["order_only_support"] and "polysemy_without_context_penalty" in r.penalties_applied


def test_anchors_margins_and_empty_rows(hardened):
    assert hardened["anchor"].shared_entity_anchor_score == 0.65 and len(hardened["anchor"].shared_anchors) == 2
    assert "ambiguous_margin_penalty" in hardened["rival"].penalties_applied and "best_second_margin_below_review_threshold" in hardened["rival"].critical_warnings
    assert (hardened["empty"].confidence, hardened["empty"].score, hardened["empty"].penalties_applied) == ("no_link", 0.0, ["empty_pozhippurai_penalty"])
    assert hardened["rival"].sequence_alignment_method == "rule_or_unavailable" and hardened["order"].neighbor_anchor_score == 0.0 and hardened["gap"].neighbor_anchor_score == 0.6


def test_granularity_and_anchor_steps(spark):
    sizes = [(1, 2, "x"), (2, 5, "x"), (2, 8, "x"), (1, 5, "x"), (1, 8, "explains_line"), (1, 9, "explains_line")]
    rows = spark.createDataFrame(sizes, "a int, b int, r string")
    assert [r[0] for r in rows.select(linking.granularity_score(F.col("a"), F.col("b"), F.col("r"))).collect()] == [1.0, 1.0, 0.6, 0.25, 0.8, 0.5]
    anchors = spark.createDataFrame([(["A.b.c"], ["A.b.c"]), (["A.b.c"], ["A.x.y"]), (["A.b.c"], ["B.b.c"]), ([], ["B.b.c"])], "a array<string>, b array<string>")
    assert [round(r[0], 2) for r in anchors.select(linking.anchor_score(F.col("a"), F.col("b"))).collect()] == [0.5, 0.28, 0.0, 0.0]


def test_reranked_targets_lie_in_the_passage(spark):
    whole = "ஒன்றும் இல்லை, சடையில் கங்கை தரித்தவன்; வேறு சொல் பல சொல்"
    rows = spark.createDataFrame([(*link("weak", "சடை புனல்", "வேறு சொல் பல சொல்", note=ORDER, at=whole.index("வேறு")), whole), (*link("firm", "சடை புனல்", "வேறு சொல்", level="high", at=0), whole)], f"{ROW}, full string")
    pack = Pack(lexicon=(CueRule("LEX_IMAGE", ("புனல்",), ("கங்கை",), 0.9, "interprets_image"),), ontology=PACK.ontology, relation_cues=PACK.relation_cues)
    got = {r.source_text + r.method: r for r in hardening.reranked(rows, "full", pack).collect()}
    assert {r.link_id for r in hardening.reranked(rows, "full", PACK).collect()} == {"weak", "firm"}
    new = got["சடை புனல்v4_hardened_global_sequence_rerank"]
    assert new.target_text == "சடையில் கங்கை தரித்தவன்" and whole[new.target_start_char : new.target_end_char] == new.target_text and len(got) == 2


def test_quality_rules(spark):
    texts = ["-", "123", "௧", "ஒன்று", "உடைய", "தீ", "ஓர் தூ வெண்மதி", "", "abc def", "ஓர் தூ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.text_quality(F.col("t")).alias("q")).select("q.status", "q.flags").collect()
    assert [(r.status, r.flags[0]) for r in rows] == [
        ("reject", "punctuation_only"), ("reject", "numeric_only"), ("reject", "numeric_only"), ("reject", "numeric_only"), ("reject", "generic_single_token"), ("keep", "short_but_valid_single_token"), ("keep", "clean"),
        ("reject", "empty"), ("reject", "no_tamil_text"), ("keep", "very_short_span"),
    ]


def test_candidate_pool(spark):
    text, target = "தோடு உடைய செவியன்", "தோடணிந்த திருச்செவியை உடைய"
    schema = "link_id string, book int, source_field string, target_field string, source_text string, target_text string, source_start_char int, source_end_char int, target_start_char int, target_end_char int, full_source string, full_target string"
    rows = [("keep", 1, "paadal_text", "pozhppurai", text, target, 0, 17, 0, 26, text, target), ("field", 1, "paadal_text", "kurippurai", text, target, 0, 17, 0, 26, text, target), ("off", 9, "paadal_text", "pozhppurai", "உடைய", target, 5, 8, 0, 26, text, target)]
    kept, lost = cleaning.candidate_pool(spark.createDataFrame(rows, schema), [1, 2])
    assert [(r.link_id, r.quality_flags) for r in kept.collect()] == [("keep", "clean")]
    assert {r.link_id: r.exclusion_reasons for r in lost.collect()} == {"field": "target_field_not_pozhippurai", "off": "not_main_scope|source_generic_single_token|source_offset_mismatch"}


def test_rule_links_find_endings_only_for_gold(spark):
    passages = spark.createDataFrame([("p1", "c1", "வெண்ணிலாவை கண்டான்", "பிறைமதியைக் கண்டான்", None), ("p2", "c2", "x", "", None), (None, None, None, None, None)], "passage_id string, commentary_id string, text string, pozhppurai string, kurippurai string")
    rules = [goldlinks.Rule("g", "வெண்ணிலா", "பிறைமதி", "interprets_image", "high"), goldlinks.Rule("other", "வெண்ணிலா", "பிறைமதி", "interprets_image", "high", passage_id="p9"), goldlinks.Rule("k", "வெண்ணிலா", "x", "glosses_word", "medium", "kurippurai")]
    (plain,) = goldlinks.rule_links(passages, rules).collect()
    assert (plain.source_text, plain.target_text, plain.score) == ("வெண்ணிலா", "பிறைமதி", 0.92) and plain.link_id.startswith("ppl_v3_")
    assert goldlinks.rule_links(passages, rules, gold=True).first().link_id.startswith("ppl_v4_") and goldlinks.rule_links(passages.limit(0), rules).count() == 0
    assert goldlinks.rule_errors([goldlinks.Rule("r", "a", "b", "none", "high")]) == ["rule 1: unknown relationship 'none'"]


def test_overlap_flags_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(f"l{i}", f"p{i % 5}", a := rng.randint(0, 60), a + rng.randint(0, 12)) for i in range(150)]
    others = [(f"p{i % 5}", a := rng.randint(0, 60), a + rng.randint(0, 6)) for i in range(25)]
    links = spark.createDataFrame(rows, "link_id string, passage_id string, source_start_char int, source_end_char int")
    got = {r.link_id: r.split_parent for r in goldlinks.overlaps_any(links, spark.createDataFrame(others, "passage_id string, source_start_char int, source_end_char int")).collect()}
    assert got == {n: any(p == q and a < d and c < b for q, c, d in others) for n, p, a, b in rows}


def test_attribution(spark):
    kind = "struct<intent string, term string, expanded boolean, group_by string, {} array<string>, {} bigint, top_group_key string, {} {}>"
    expected = kind.format("required_matched_terms", "min_total_occurrences", "requires_evidence_samples", "boolean").replace(" string", ": string").replace(" boolean", ": boolean").replace(" array", ": array").replace(" bigint", ": bigint")
    observed = kind.format("matched_terms", "total_occurrences", "evidence_samples", "bigint").replace(" string", ": string").replace(" boolean", ": boolean").replace(" array", ": array").replace(" bigint", ": bigint")
    cases = [(("group_by_author", "x", None, None, None, None, None, None), ("group_by_category", "x", None, None, None, None, None, None)), ((None, None, None, None, ["a", "b"], None, None, None), (None, None, None, None, ["a"], None, None, None)), ((None,) * 8, None), ((None, None, None, None, None, 5, None, None), (None, None, None, None, None, 0, None, None))]
    rows = spark.createDataFrame(cases, f"expected {expected}, observed {observed}")
    assert [tuple(r[0]) for r in rows.select(benchmarks.attributed()).collect()] == [("analytics_gap", 0.92), ("synonym_gap", 0.86), ("architecture_gap", 0.95), ("data_gap", 0.84)]


def test_promotion_gates(spark):
    columns = "confidence string, score double, learned_pattern_score double, paraphrase_score double, anchor_resolver_score double, polysemy_safety_score double, ontology_relation_score double, relationship_cue_score double, best_second_margin double, relationship_type string, non_order_evidence double, penalties_applied array<string>, critical_warnings array<string>, issues array<string>, manual_review_required boolean"
    good = ("medium", 0.9, 0.9, 0.9, 0.9, 1.0, 0.9, 0.9, 0.2, "interprets_image", 3.0, [], [], [], True)
    rows = [good, ("low", 0.5, 0.5, 0.4, 0.5, 1.0, 0.5, 0.5, 0.2, "interprets_image", 1.3, ["target_too_broad_penalty"], [], [], True), ("high", 0.7, *good[2:]), ("medium", *good[1:10], 0.2, [], [], [], False), ("medium", *good[1:11], ["order_only_penalty"], [], [], False)]
    got = promotion.promoted(spark.createDataFrame(rows, columns).select("*", F.monotonically_increasing_id().alias("i")), F.lit(False)).orderBy("i").collect()
    assert [(r.confidence, r.promotion_decision, r.order_only_evidence_gate) for r in got] == [("high", "PROMOTE_HIGH", "pass"), ("medium", "PROMOTE_MEDIUM", "pass"), ("high", "UNCHANGED", "pass"), ("medium", "UNCHANGED", "block"), ("medium", "REJECTED_ORDER_ONLY", "block")]


def test_anchor_resolution(spark):
    rules = [promotion.AnchorRule("MOON", "CELESTIAL", ("பிறை", "மதி"), "wears(X,MOON)", "interprets_image", ("சடை", "முடி")), promotion.AnchorRule("HAIR", "BODY_PART", ("சடை",), "wears(X,HAIR)", "interprets_image")]
    rows = spark.createDataFrame([("a", "பிறை சடை", "சடையில் மதி", "interprets_image"), ("b", "மதி", "ஒன்று", "x")], "link_id string, source_text string, target_text string, relationship_type string")
    got = {r.link_id: r for r in promotion.with_resolution(rows, rules, [("MOON", "HAIR", "wears(X,MOON)")]).collect()}
    assert got["a"].matched_anchors == ["HAIR", "MOON"] and got["a"].missing_anchor_resolved and got["a"].ontology_relations == ["wears(X,HAIR)", "wears(X,MOON)"]
    assert got["b"].matched_anchors == [] and not got["b"].missing_anchor_resolved and got["b"].review_reason in ("no_shared_ontology_anchor", "anchor_found_only_on_source")


def test_stems():
    assert stem_forms("கடலை") == ["கடலை"] and stem_forms("மலர்களை") == ["மலர்களை", "மலர்"]


def test_subspans_and_minimal_targets(spark):
    from corpusloom.operators import cues, subspans

    text = "ஒன்றும் இல்லை, சடையில் கங்கை சூடி; இன்பம் தரும் சொல். பல சொல் வேறு"
    assert [text[a:b] for a, b, _ in subspans.clauses(text)] == ["ஒன்றும் இல்லை", "சடையில் கங்கை சூடி", "இன்பம் தரும் சொல்", "பல சொல் வேறு"] and subspans.clauses("") == []
    phrases = list(subspans.cue_phrases(text))
    assert all(text[a:b] == p for a, b, p in phrases) and any(p == "சடையில் கங்கை சூடி" for *_, p in phrases)
    rows = spark.createDataFrame([(*link("wide", "சடை கங்கை", text, level="medium"), ["target_too_broad_penalty"]), (*link("small", "சடை கங்கை", "கங்கை சூடி"), []), (*link("none", "x", "", "unlinked"), [])], f"{ROW}, penalties_applied array<string>")
    kinds = {(r.link_id, r.kind) for r in subspans.subspans(rows, ["link_id"]).collect()}
    assert ("wide", "two_neighboring_clauses") in kinds and ("wide", "full_target_fallback") in kinds and not any(n == "none" for n, _ in kinds)
    broad = cues.prepared(rows, "source_text", "target_text").select("link_id", subspans.is_broad(F.lit(False)).alias("b"), subspans.cue_families(F.col("target_text")).alias("f"))
    assert {r.link_id: r.b for r in broad.collect()} == {"wide": True, "small": False, "none": False}
    (best,) = subspans.minimal_targets(rows, PACK).where("link_id = 'wide'").collect()
    assert "கங்கை" in best.target_text_minimal and text[best.local_start : best.local_end] == best.target_text_minimal and len(best.target_text_minimal) < 0.75 * len(text)
