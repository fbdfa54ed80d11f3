"""Targets that are too broad: their clauses, pairs of clauses and phrases around cues, and the least of them that still carries the link."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.find import clean_phrase
from corpusloom.functions.generate import generated
from corpusloom.operators import cues, hardening
from corpusloom.operators.cues import Pack

#: Cues by family, further words at which a phrase may end, and endings that leave a clause open; fixed values
CUE_FAMILIES = {
    "image": ("சூடி", "சூடிப்", "சூடிய", "அணிந்து", "ஏந்தி", "பூசி", "சடை", "முடி", "சென்னி", "பிறை", "திங்கள்", "மதி", "கங்கை", "பாம்பு", "நாகம்", "அரவு", "மழு", "தோல்", "கபாலம்", "விடை", "எருது"),
    "entity": ("சிவபிரான்", "சிவபெருமான்", "இறைவன்", "இறைவர்", "பெருமான்", "அண்ணல்", "தலைவன்", "எந்தை", "உமையம்மை", "ஞானசம்பந்தன்", "திருவீழிமிழலை", "திருமுதுகுன்றம்", "ஆலவாய்", "அண்ணாமலை", "காழி"),
    "worship": ("தொழுது", "தொழ", "கைதொழ", "பணிந்து", "ஏத்தி", "போற்றி", "வழிபட்டு", "அருச்சித்து", "மலர் தூவி", "மனங்கொள்", "நினை"),
    "result": ("இன்பம்", "செல்வம்", "உயர்வு", "வாழ்வர்", "நீங்கும்", "கெடும்", "பிணி", "வினை", "பாசம்", "எமபயம்", "முத்தி", "வீடு"),
    "phrase": ("என்பது", "என்னும்", "அல்லனோ", "அஞ்சுமாறு", "உடைய", "பொருந்திய", "நிறைந்த", "விளங்கும்"),
}
BOUNDARY_WORDS = ("ஆகிய", "ஆகியவர்", "உடையவர்", "தரித்து", "விளங்கும்", "உறையும்", "எழுந்தருளிய", "வரின்", "ஆயின்", "எனில்", "அதனால்", "ஆகும்", "பெறுவர்")
UNSAFE_ENDINGS = ("்", "உம்", "வும்", "களும்", "னும்", "தும்", "ரும்", "என", "விளைந்த", "வாழ்த்தி", "வழிபட்டு", "செலுத்தி", "போற்றி", "ஏத்தி", "தொழுது", "பணிந்து")
CLAUSE_BREAK = r"[,;.!?:\-—“”‘’\n]+"
LEFT_REACH, RIGHT_REACH, LONGER = 18, 36, 4
#: Weights of a candidate's score, of cues that it shares with the source, and how much shorter and how little worse it must be; fixed values
SCORE_WEIGHTS = {"surface_token_overlap": 0.20, "semantic_lexicon_score": 0.20, "shared_entity_anchor_score": 0.20, "ontology_relation_score": 0.15, "relationship_cue_score": 0.10, "neighbor_anchor_score": 0.10, "target_granularity_score": 0.05}
FAMILY_SHARE, CUE_SHARE, NO_FAMILY, ONE_WORD = 0.10, 0.15, 0.12, 0.10
SHORTER, WORSE, BROAD_ALLOWANCE = 0.75, 0.03, 0.08
_BREAKS = re.compile(CLAUSE_BREAK)
_CUES = re.compile("|".join(sorted(map(re.escape, {w for own in CUE_FAMILIES.values() for w in own} | set(BOUNDARY_WORDS)), key=len, reverse=True)))


def _held(text: Column, words) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def cue_families(text: Column) -> Column:
    """Names of the families of which the text has a cue."""
    return F.array_compact(F.array(*[F.when(F.size(_held(text, words)) > 0, name) for name, words in CUE_FAMILIES.items()]))


def cue_terms(text: Column) -> Column:
    """All cues that the text has."""
    return _held(text, dict.fromkeys(w for words in CUE_FAMILIES.values() for w in words))


def is_broad(whole_source: Column) -> Column:
    """Whether a link's target says much more than its source: rows prepared on both texts. whole_source: a source that is the whole passage is never outdone."""
    source, target = F.size("_source_text_t"), F.size("_target_text_t")
    ratio = target / F.greatest(F.lit(1), source)
    clauses = F.size(F.filter(F.split("target_text", CLAUSE_BREAK), lambda x: F.trim(x) != ""))
    many = (F.size(cue_families(F.col("target_text"))) >= 3) & (target >= F.greatest(F.lit(8), 2 * source))
    wide = F.array_contains("penalties_applied", "target_too_broad_penalty") | (ratio > 3.0) | many | ((clauses >= 2) & (ratio > 2.5))
    return (F.col("relationship_type") != "unlinked") & (F.coalesce("target_text", F.lit("")) != "") & ~whole_source & wide


def clauses(text: str) -> list[tuple[int, int, str]]:
    """Cleaned clauses between breaks, with their places."""
    edges = [0, *(x for m in _BREAKS.finditer(text) for x in m.span()), len(text)]
    out = []
    for low, high in zip(edges[::2], edges[1::2], strict=True):
        own = clean_phrase(text[low:high])
        at = text.find(own, low, high) if own else -1
        if at >= 0:
            out.append((at, at + len(own), own))
    return out


def _is_open(phrase: str) -> bool:
    words = phrase.split()
    return not words or words[-1].endswith(UNSAFE_ENDINGS)


def cue_phrases(text: str) -> Iterator[tuple[int, int, str]]:
    """Phrases of two words or more around each cue: from the nearest stop, or a space some way before it, to the nearest stop or a space some way after, and on while the last word leaves it open."""
    stops = [m.start() for m in re.finditer("[,;.]", text)]
    for m in _CUES.finditer(text):
        low = max([s for s in stops if s < m.start()] + [text.rfind(" ", 0, max(0, m.start() - LEFT_REACH))]) + 1
        after = [s for s in stops if s >= m.end()]
        space = text.find(" ", min(len(text), m.end() + RIGHT_REACH))
        high = after[0] if after else space if space >= 0 else len(text)
        phrase = clean_phrase(text[low:high])
        if len(phrase.split()) < 2:
            continue
        for _ in range(LONGER):
            if high >= len(text) or not _is_open(phrase):
                break
            high = min((x for x in (text.find(" ", high + 1), *(s for s in stops if s > high)) if x > high), default=len(text))
            phrase = clean_phrase(text[low:high])
        at = text.find(phrase, low)
        if at >= 0:
            yield at, at + len(phrase), phrase


def _candidates():
    def find(text):
        text = text or ""
        own = clauses(text)
        found = [(a, b, x, "single_clause") for a, b, x in own]
        for (a, *_), (_, b, _) in zip(own, own[1:], strict=False):
            found.append((a, b, text[a:b], "two_neighboring_clauses"))
        found += [(a, b, x, "cue_phrase") for a, b, x in cue_phrases(text)]
        found.append((0, len(text), text, "full_target_fallback"))
        first: dict[str, tuple] = {}
        for c in found:
            if c[1] > c[0]:
                first.setdefault(c[2], c)
        yield from sorted(first.values(), key=lambda c: (len(c[2].split()), c[0]))

    return find


def subspans(rows: DataFrame, keep: list[str], target: str = "target_text") -> DataFrame:
    """keep, candidate_start, candidate_end, candidate, kind: clauses, pairs of neighbouring ones, phrases around cues and the whole of each target, each text once."""
    return generated(rows, keep, [target], "candidate_start bigint, candidate_end bigint, candidate string, kind string", _candidates)


def _share(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def minimal_targets(links: DataFrame, pack: Pack) -> DataFrame:
    """link_id, local_start, local_end, target_text_minimal, kind, minimal_target_score, original_target_score of links whose target can shrink.

    A candidate has less than three quarters of the target's characters, a score hardly below the target's own, a cue family and a
    cue of the source where that has any, and evidence; the best score wins, then the shorter text, then the earlier one.
    """
    columns = [c for c in links.columns if c != "target_text"]
    base = links.withColumn("_whole", F.col("target_text"))
    found = subspans(base, [*columns, "_whole"]).withColumnRenamed("candidate", "target_text")
    rows = hardening.with_features(found, pack)
    source_families, families = cue_families(F.col("source_text")), cue_families(F.col("target_text"))
    source_cues, own_cues = cue_terms(F.col("source_text")), cue_terms(F.col("target_text"))
    raw = sum((w * F.col(n) for n, w in SCORE_WEIGHTS.items()), F.lit(0.0)) + FAMILY_SHARE * _share(source_families, families) + CUE_SHARE * _share(source_cues, own_cues)
    raw = raw - F.when((F.size(families) == 0) & (F.size(source_families) > 0), NO_FAMILY).otherwise(0.0) - F.when((F.size("_target_text_t") < 2) & (F.size("_source_text_t") > 2), ONE_WORD).otherwise(0.0)
    evidence = sum((F.col(c) for c in hardening.RELATION_EVIDENCE), F.lit(0.0))
    shared = F.arrays_overlap(source_families, families)
    carried = ((F.size(source_families) == 0) | shared) & ((F.size(source_cues) == 0) | F.arrays_overlap(source_cues, own_cues)) & ((evidence >= 0.15) | shared)
    rows = rows.select("link_id", "penalties_applied", "_whole", "candidate_start", "candidate_end", "target_text", "kind", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4).alias("_score"), carried.alias("_carried"))
    original = rows.where(F.col("target_text") == F.col("_whole")).select("link_id", F.col("_score").alias("original_target_score"))
    allowed = F.col("original_target_score") - F.when(F.array_contains("penalties_applied", "target_too_broad_penalty"), BROAD_ALLOWANCE).otherwise(0.0)
    size = F.length("target_text")
    fit = rows.join(original, "link_id").where((size < SHORTER * F.length("_whole")) & F.col("_carried") & (F.col("_score") + WORSE >= F.greatest(F.lit(0.0), allowed)))
    best = fit.groupBy("link_id").agg(F.max_by(F.struct("candidate_start", "candidate_end", "target_text", "kind", "_score", "original_target_score"), F.struct("_score", -size, -F.col("candidate_start"))).alias("b"))
    return best.select("link_id", F.col("b.candidate_start").alias("local_start"), F.col("b.candidate_end").alias("local_end"), F.col("b.target_text").alias("target_text_minimal"), "b.kind", F.col("b._score").alias("minimal_target_score"), "b.original_target_score")
