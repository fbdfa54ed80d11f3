"""Registered queries of link building, hardening, cleaning, promotion and evaluation, over links made of conversations.

A user turn stands for a line of verse and the reply for its commentary; relations, confidences and notes come from ids, so
that every rule is met. The SQL of each query is written from the rules and not from the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import benchmarks, cleaning, cues, evaluation, goldlinks, hardening, linking, promotion, ragpack
from corpusloom.operators.cues import Anchor, CueRule, Expansion, Pack, Pattern
from corpusloom.plans.catalogue import _RECORDS, conversation_records, registered, table

RELATIONS = (*goldlinks.RELATIONSHIPS, "unlinked")
NOTES = ("", "Focused QA rule matched: x", "mainly supported by poem/commentary order", "best target is close")

#: A pack of cues of the prose in the tables; fixed values
PACK = Pack(
    lexicon=(CueRule("lex_1", ("the|les|der",), ("and|et|und",), 0.3, "explains_phrase"), CueRule("lex_2", ("tion + ou", "ver"), ("ment", "sch"), 0.25, "interprets_image")),
    morphology=(CueRule("mor_1", ("que",), ("qu",), 0.06), CueRule("mor_2", ("en la", "in die"), ("de la", "der"), 0.08)),
    ontology=(CueRule("ont_1", ("ver", "qu"), ("de la", "sch"), 0.4, "describes_entity"), CueRule("ont_2", ("th",), ("ing",), 0.2, "theological_explanation")),
    expansions=(Expansion("ART", "def", "the", ("les", "der")), Expansion("ART", "indef", "un", ("ein",)), Expansion("CON", "and", "and", ("et", "und"))),
    relation_cues={"explains_phrase": ("tion", "the"), "interprets_image": ("eau", "ung", "ver", "ing"), "glosses_word": ("que",)},
    polysemous=("die", "le"),
)
WEIGHTS = {"surface_token_overlap": 0.1, "char_ngram_overlap": 0.08, "semantic_lexicon_score": 0.12, "shared_entity_anchor_score": 0.1, "ontology_relation_score": 0.1, "target_granularity_score": 0.06, "field_preference_score": 0.04}
PENALTIES = {"order_only_penalty": 0.2, "ambiguous_margin_penalty": 0.1, "missing_entity_anchor_penalty": 0.05, "target_too_broad_penalty": 0.08, "polysemy_without_context_penalty": 0.06}


def _pick(names, at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))


def links_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link rows of all user turns with a reply."""
    c, t = F.col("conv_id"), F.col("turn")
    return conversation_records(spark, sf_dir).where("pozhppurai <> ''").select(
        F.col("record_id").alias("link_id"), F.col("record_id").alias("commentary_id"), "conv_id", "turn", F.col("verse").alias("source_text"), F.col("pozhppurai").alias("target_text"), _pick(RELATIONS, c + t).alias("relationship_type"),
        _pick(("high", "medium", "low", "no_link"), 3 * c + F.floor(t / 2)).alias("confidence"), ((c * 13 + t * 7) % 100 / 100).alias("score"), F.when(t % 4 == 0, "kurippurai").otherwise("pozhppurai").alias("target_field"),
        F.when(c % 11 == 0, "v4_gold_x").otherwise("plain").alias("method"), _pick(NOTES, c).alias("diagnostic_note"), (c % 20 / 100).alias("score_margin"), (c % 3 == 0).alias("manual_review_required"),
        (t * 10).alias("source_start_char"), (t * 10 + F.length("verse")).alias("source_end_char"), F.when((c % 5 != 0) | (t != 2), (c * 7 + t * 31) % 97).alias("target_start_char"),
    )


def _case(names, at: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + f"][({at}) % {len(names)} + 1]"


_BREAK = r"""[\s,.;:!?()\[\]{}"\x27“”‘’\-]+"""
_LINKS = rf"""{_RECORDS}, b AS (
  SELECT record_id AS link_id, conv_id, turn, verse AS source_text, pozhppurai AS target_text, {_case(RELATIONS, "conv_id + turn")} AS relationship_type, {_case(("high", "medium", "low", "no_link"), "3 * conv_id + turn // 2")} AS confidence,
    ((conv_id * 13 + turn * 7) % 100) / 100 AS score, CASE WHEN turn % 4 = 0 THEN 'kurippurai' ELSE 'pozhppurai' END AS target_field, CASE WHEN conv_id % 11 = 0 THEN 'v4_gold_x' ELSE 'plain' END AS method,
    {_case(NOTES, "conv_id")} AS note, (conv_id % 20) / 100 AS margin, conv_id % 3 = 0 AS review, turn * 10 AS a, turn * 10 + length(verse) AS b, CASE WHEN conv_id % 5 <> 0 OR turn <> 2 THEN (conv_id * 7 + turn * 31) % 97 END AS c
  FROM r WHERE pozhppurai <> ''
), n AS (SELECT *, trim(regexp_replace(nfc_normalize(source_text), '\s+', ' ', 'g')) AS sn, trim(regexp_replace(nfc_normalize(target_text), '\s+', ' ', 'g')) AS tn, CASE WHEN relationship_type <> 'unlinked' AND confidence <> 'no_link' AND source_text <> '' THEN true ELSE false END AS linked FROM b),
p AS (SELECT *, replace(sn, ' ', '') AS sc, replace(tn, ' ', '') AS tc, list_filter(regexp_split_to_array(sn, '{_BREAK}'), lambda x: x <> '') AS st, list_filter(regexp_split_to_array(tn, '{_BREAK}'), lambda x: x <> '') AS tt FROM n)"""


def _in(side: str, cue: str) -> str:
    return f"(contains({side}n, '{cue}') OR contains({side}c, '{cue.replace(' ', '')}'))"


def _expression(side: str, cue: str) -> str:
    return "(" + " AND ".join("(" + " OR ".join(_in(side, a.strip()) for a in g.split("|")) + ")" for g in cue.split("+")) + ")"


def _any(side: str, words) -> str:
    return "(" + " OR ".join(_expression(side, w) for w in words) + ")"


def _rules(rules, biased: bool) -> str:
    return "least(1.0, " + " + ".join(f"CASE WHEN {_any('s', r.source)} AND {_any('t', r.target)} THEN {r.weight}" + (f" + CASE WHEN relationship_type = '{r.bias}' THEN 0.05 ELSE 0 END" if biased else "") + " ELSE 0 END" for r in rules) + ")"


def _anchors(side: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(_in(side, a) for a in (*e.aliases, e.canonical))} THEN '{e.name}' END" for e in PACK.expansions) + "], lambda x: x IS NOT NULL)"


_OVERLAP = "CASE WHEN len(st) = 0 OR len(tt) = 0 THEN 0 ELSE len(list_intersect(list_distinct(st), list_distinct(tt))) / len(list_distinct(list_concat(st, tt))) END"
_GRAMS = "list_distinct(list_transform(range(1, length({0}c) - 1), lambda i: substr({0}c, i, 3)))"
_NGRAMS = f"CASE WHEN length(sc) < 3 OR length(tc) < 3 THEN 0 ELSE len(list_intersect({_GRAMS.format('s')}, {_GRAMS.format('t')})) / len(list_distinct(list_concat({_GRAMS.format('s')}, {_GRAMS.format('t')}))) END"
_RATIO = "greatest(1, len(tt)) / greatest(1, len(st))"
_SIZE = f"CASE WHEN relationship_type = 'explains_line' THEN CASE WHEN {_RATIO} <= 8 THEN 0.8 ELSE 0.5 END WHEN {_RATIO} <= 2.5 THEN 1.0 WHEN {_RATIO} <= 4 THEN 0.6 ELSE 0.25 END"
_RELATION_CUES = (
    "CASE relationship_type "
    + " ".join(f"WHEN '{k}' THEN least(1.0, ({' + '.join(f'CAST(contains(sn || chr(32) || tn, {w!r}) OR contains(sc || tc, {w!r}) AS INT)' for w in words)}) / 4)" for k, words in PACK.relation_cues.items())
    + " ELSE 0 END"
)
_FEATURES = f"""{_LINKS}, f0 AS (SELECT *, {_anchors("s")} AS sa, {_anchors("t")} AS ta, {_OVERLAP} AS overlap FROM p),
f AS (
  SELECT *, {_NGRAMS} AS ngrams, {_rules(PACK.lexicon, True)} AS lexicon, {_rules(PACK.morphology, False)} AS morphology, {_rules(PACK.ontology, True)} AS ontology, {_RELATION_CUES} AS cues, {_SIZE} AS size,
    CASE WHEN len(list_intersect(sa, ta)) > 0 THEN least(1.0, 0.35 + 0.15 * len(list_intersect(sa, ta)))
      WHEN len(list_intersect(list_transform(sa, lambda x: split_part(x, '.', 1)), list_transform(ta, lambda x: split_part(x, '.', 1)))) > 0
      THEN least(0.45, 0.2 + 0.08 * len(list_intersect(list_distinct(list_transform(sa, lambda x: split_part(x, '.', 1))), list_distinct(list_transform(ta, lambda x: split_part(x, '.', 1)))))) ELSE 0 END AS entity,
    CASE WHEN starts_with(method, 'v4_gold') THEN 1.0 WHEN contains(note, 'Focused QA rule matched') THEN 0.9 WHEN confidence = 'high' AND score >= 0.75 THEN 0.75 WHEN overlap >= 0.35 THEN 0.35 ELSE 0 END AS gold,
    CASE target_field WHEN 'pozhppurai' THEN 1.0 WHEN 'kurippurai' THEN 0.85 ELSE 0.5 END AS field
  FROM f0
)"""


@registered(f"WITH {_FEATURES} SELECT link_id, {', '.join(f'CAST(round_even(CAST({c} AS DOUBLE), 4) AS DOUBLE) AS {c}' for c in ('overlap', 'ngrams', 'lexicon', 'morphology', 'ontology', 'entity', 'cues', 'gold', 'size', 'field'))} FROM f")
def link_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence features of every link."""
    rows = hardening.with_features(links_of(spark, sf_dir), PACK)
    names = {
        "overlap": "surface_token_overlap", "ngrams": "char_ngram_overlap", "lexicon": "semantic_lexicon_score", "morphology": "morphology_stem_score", "ontology": "ontology_relation_score", "entity": "shared_entity_anchor_score",
        "cues": "relationship_cue_score", "gold": "gold_pattern_similarity", "size": "target_granularity_score", "field": "field_preference_score",
    }
    return rows.select("link_id", *[F.col(c).alias(n) for n, c in names.items()])


_SEQUENCE = """s0 AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY a, link_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, lag(c) OVER w AS before, lead(c) OVER w AS after FROM {} WINDOW w AS (PARTITION BY conv_id ORDER BY a, link_id)),
s1 AS (SELECT *, count(c) OVER (PARTITION BY conv_id) >= 3 AND count(*) FILTER (c < seen) OVER (PARTITION BY conv_id) > count(*) FILTER (c >= seen) OVER (PARTITION BY conv_id) AS reverse FROM s0),
s2 AS (SELECT *, CAST(before IS NOT NULL AS INT) + CAST(after IS NOT NULL AS INT) AS asked, coalesce(CAST(CASE WHEN reverse THEN c <= before ELSE c >= before END AS INT), 0) + coalesce(CAST(CASE WHEN reverse THEN c >= after ELSE c <= after END AS INT), 0) AS agreed FROM s1),
s3 AS (SELECT *, CASE WHEN c IS NULL THEN 0 WHEN asked = 0 THEN 0.5 ELSE agreed / asked END AS sequence, CASE WHEN c IS NULL OR asked = 0 THEN 0 WHEN asked = 1 THEN 0.6 * agreed WHEN c BETWEEN least(before, after) AND greatest(before, after) THEN 1.0 ELSE 0.25 END AS neighbor,
  CASE WHEN c IS NULL THEN 'rule_or_unavailable' WHEN reverse THEN 'reverse_order_alignment' ELSE 'global_sequence_assignment' END AS sequence_method FROM s2)"""


@registered(f"WITH {_LINKS}, {_SEQUENCE.format('p')} SELECT link_id, CAST(round(sequence, 3) AS DOUBLE) AS sequence, CAST(round(neighbor, 3) AS DOUBLE) AS neighbor, sequence_method FROM s3")
def link_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well links agree with their neighbours in the conversation."""
    rows = hardening.with_sequence(links_of(spark, sf_dir), "conv_id")
    return rows.select("link_id", F.round("sequence_consistency_score", 3).alias("sequence"), F.round("neighbor_anchor_score", 3).alias("neighbor"), F.col("sequence_alignment_method").alias("sequence_method"))


_WEIGHTED = " + ".join(f"{WEIGHTS[k]} * {v}" for k, v in {"surface_token_overlap": "round_even(overlap, 4)", "char_ngram_overlap": "round_even(ngrams, 4)", "semantic_lexicon_score": "lexicon", "shared_entity_anchor_score": "entity", "ontology_relation_score": "ontology", "target_granularity_score": "size", "field_preference_score": "field"}.items())


@registered(
    f"""WITH {_FEATURES}, {_SEQUENCE.format("f")}, q AS (SELECT *, lexicon + morphology + entity + ontology + cues + neighbor < 0.2 AND (contains(note, 'mainly supported by poem/commentary order') OR contains(note, 'share little surface vocabulary')) AS alone,
  (contains(note, 'best target is close') OR (confidence = 'low' AND margin < 0.05)) AND margin < 0.08 AS close, entity = 0 AND ontology = 0 AS unanchored, relationship_type <> 'explains_line' AND len(tt) / greatest(1, len(st)) > 3 AS broad,
  ({" OR ".join(_in("s", w) for w in PACK.polysemous)}) AND ontology + cues + entity < 0.25 AS sense FROM s3),
x AS (SELECT *, list_filter([CASE WHEN alone THEN 'order_only_penalty' END, CASE WHEN close THEN 'ambiguous_margin_penalty' END, CASE WHEN unanchored THEN 'missing_entity_anchor_penalty' END, CASE WHEN broad THEN 'target_too_broad_penalty' END, CASE WHEN sense THEN 'polysemy_without_context_penalty' END], lambda x: x IS NOT NULL) AS named,
  alone OR (close AND margin < 0.05) AS critical,
  greatest(0, least(0.99, 0.45 * score + 1.9 * ({_WEIGHTED}) + 0.04 - CASE WHEN alone THEN 0.2 ELSE 0 END - CASE WHEN close THEN 0.1 ELSE 0 END - CASE WHEN unanchored THEN 0.05 ELSE 0 END - CASE WHEN broad THEN 0.08 ELSE 0 END - CASE WHEN sense THEN 0.06 ELSE 0 END)) AS raw FROM q)
SELECT link_id, CASE WHEN NOT linked THEN 'empty_pozhippurai_penalty' ELSE array_to_string(named, ',') END AS penalties,
  CASE WHEN NOT linked THEN 'no_link' WHEN confidence = 'high' AND gold >= 0.75 AND NOT critical THEN 'high' WHEN raw >= 0.78 AND NOT critical AND lexicon + ontology + cues + entity >= 0.35 THEN CASE WHEN close THEN 'medium' ELSE 'high' END WHEN raw >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
  CAST(round_even(CAST(CASE WHEN NOT linked THEN 0 WHEN confidence = 'high' AND gold >= 0.75 AND NOT critical THEN greatest(raw, 0.82) ELSE raw END AS DOUBLE), 4) AS DOUBLE) AS score FROM x"""
)
def link_hardening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalties, hardened score and confidence of every link."""
    rows = hardening.harden(links_of(spark, sf_dir), "conv_id", PACK, WEIGHTS, PENALTIES)
    return rows.select("link_id", F.array_join("penalties_applied", ",").alias("penalties"), "confidence", "score")


#: Reviewed anchors and patterns of the prose; fixed values
BLOCKERS = Pack(
    anchors=(Anchor("anc_1", "the", ("les", "der")), Anchor("anc_2", "und", ("et",), ("tion", "ung")), Anchor("anc_3", "que", ("de la",))),
    patterns=(Pattern("pat_1", (("ver", "eau"),), (("sch", "ment"), ("en", "in")), "explains_phrase"), Pattern("pat_2", (("th",),), (("ing", "ed"),), "glosses_word")),
)


def _stem(side: str, words) -> str:
    """Cues without Tamil endings: in the compact text; of a cue of several words one is enough, if it is a token."""
    tokens = {"sc": "st", "tc": "tt"}.get(side, "list_concat(st, tt)")
    each = [f"contains({side}, '{w.replace(' ', '')}')" for w in words]
    each += [f"list_has_any({tokens}, {w.split()!r})" for w in words if " " in w]
    return "(" + " OR ".join(each) + ")"


_BLOCKED = f"""{_LINKS}, a0 AS (SELECT *, {_OVERLAP} AS overlap, {_SIZE} AS size,
  CAST({_stem("sc", ("les", "der", "the"))} AND {_stem("tc", ("les", "der", "the"))} AS INT) + CAST({_stem("sc", ("et", "und"))} AND {_stem("tc", ("et", "und"))} AND {_stem("(sc || tc)", ("tion", "ung"))} AS INT) + CAST({_stem("sc", ("de la", "que"))} AND {_stem("tc", ("de la", "que"))} AS INT) AS na,
  CAST({_stem("sc", ("ver", "eau"))} AND {_stem("tc", ("sch", "ment"))} AND {_stem("tc", ("en", "in"))} AS INT) + CAST({_stem("sc", ("th",))} AND {_stem("tc", ("ing", "ed"))} AS INT) AS np,
  CAST(relationship_type = 'explains_phrase' AND {_stem("(sc || tc)", ("sch", "ment"))} AND {_stem("(sc || tc)", ("en", "in"))} AS INT) + CAST(relationship_type = 'glosses_word' AND {_stem("(sc || tc)", ("ing", "ed"))} AS INT) AS nr FROM p),
a1 AS (SELECT *, least(1.0, 0.22 * np + 0.10 * na) AS lexicon, least(1.0, 0.24 * na) AS shared, least(1.0, 0.28 * na + 0.10 * np) AS expanded, least(1.0, 0.30 * np) AS ontology, least(1.0, nr / 2) AS relation FROM a0),
a2 AS (SELECT *, CASE WHEN lexicon + shared + expanded + ontology + relation >= 0.3 OR (confidence IN ('high', 'medium') AND score >= 0.45) THEN 1 ELSE 0 END AS gate, lexicon + expanded + ontology + relation AS evidence, confidence IN ('low', 'no_link', '') AS weak FROM a1),
a3 AS (SELECT *, relationship_type <> 'explains_line' AND len(tt) / greatest(1, len(st)) > 3 AS broad, weak AND expanded = 0 AND ontology = 0 AS missing, weak AND margin < 0.05 AS close, gate = 0 AND (weak OR contains(lower(note), 'order') OR contains(lower(note), 'wrong target')) AS alone FROM a2),
a4 AS (SELECT *, greatest(0, least(0.99, 0.78 * score + 0.14 * evidence + 0.08 * size - 0.06 * (CAST(broad AS INT) + CAST(missing AS INT) + CAST(close AS INT) + CAST(alone AS INT)) - CASE WHEN broad THEN 0.05 ELSE 0 END)) AS raw FROM a3),
a5 AS (SELECT *, CASE WHEN raw >= 0.74 AND evidence >= 0.45 AND NOT alone THEN 'high' WHEN raw >= 0.42 AND (evidence >= 0.2 OR confidence IN ('high', 'medium')) THEN 'medium' ELSE confidence END AS l1 FROM a4),
a6 AS (SELECT *, CASE WHEN confidence = 'high' AND NOT alone THEN 'high' WHEN confidence = 'medium' AND l1 = 'low' AND NOT alone THEN 'medium' ELSE l1 END AS l2, CASE WHEN confidence = 'high' AND NOT alone THEN greatest(raw, score) WHEN confidence = 'medium' AND l1 = 'low' AND NOT alone THEN greatest(raw, least(score, 0.74)) ELSE raw END AS s2 FROM a5)"""


@registered(
    f"""WITH {_BLOCKED} SELECT link_id, na AS anchors, np AS patterns, array_to_string(list_filter([CASE WHEN broad THEN 'target_too_broad_penalty' END, CASE WHEN missing THEN 'missing_entity_anchor_penalty' END, CASE WHEN close THEN 'ambiguous_margin_penalty' END, CASE WHEN alone THEN 'order_only_penalty' END], lambda x: x IS NOT NULL), ',') AS penalties,
  CASE WHEN confidence = 'no_link' THEN 'no_link' WHEN alone AND l2 = 'high' THEN 'low' ELSE l2 END AS confidence, CAST(round_even(CAST(CASE WHEN confidence = 'no_link' THEN raw ELSE s2 END AS DOUBLE), 4) AS DOUBLE) AS score,
  confidence = 'no_link' OR (alone AND l2 = 'high') OR review OR l2 = 'low' OR close OR alone AS manual_review_required FROM a6"""
)
def link_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links against reviewed anchors and patterns: penalties, score, confidence and review flag."""
    rows = hardening.blocked(hardening.with_blocker_penalties(hardening.with_blocker_features(links_of(spark, sf_dir), BLOCKERS)))
    return rows.select("link_id", F.size("anchor_ids").alias("anchors"), F.size("pattern_ids").alias("patterns"), F.array_join("penalties_applied", ",").alias("penalties"), "confidence", "score", "manual_review_required")


#: Reviewed pairs of phrases of the prose; fixed values
RULES = (
    goldlinks.Rule("g1", "en la", "de la", "explains_phrase", "high"), goldlinks.Rule("g2", "der", "und die", "glosses_word", "medium"), goldlinks.Rule("g3", "and", "the", "describes_entity", "high"),
    goldlinks.Rule("g4", "que", "tion", "interprets_image", "high", "kurippurai"), goldlinks.Rule("g5", " the, ", "ing", "explains_line", "medium"), goldlinks.Rule("g6", "de", "les", "theological_explanation", "high"),
)


def passages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as passages, with the reply as commentary and the first half of it as gloss."""
    rows = conversation_records(spark, sf_dir)
    return rows.select(
        F.col("record_id").alias("passage_id"), F.col("record_id").alias("commentary_id"), F.col("verse").alias("text"), "pozhppurai", F.expr("substring(pozhppurai, 1, cast(floor(length(pozhppurai) / 2) as int))").alias("kurippurai"),
        (F.col("conv_id") % 9).alias("book"),
    )


_DENSE = r"regexp_replace({}, '[\s,.;:!?\-–—\x27\x22“”‘’]', '', 'g')"
_PLACES = r"list_filter(range(1, length({0}) + 1), lambda i: NOT regexp_matches(substr({0}, i, 1), '[\s,.;:!?\-–—\x27\x22“”‘’]'))"


def _span(text: str, phrase: str, what: str) -> str:
    dense, squeezed = _DENSE.format(text), f"replace({phrase}, ' ', '')"
    if what == "start":
        return f"CASE WHEN contains({text}, {phrase}) THEN instr({text}, {phrase}) - 1 ELSE {_PLACES.format(text)}[instr({dense}, {squeezed})] - 1 END"
    return f"CASE WHEN contains({text}, {phrase}) THEN instr({text}, {phrase}) - 1 + length({phrase}) ELSE {_PLACES.format(text)}[instr({dense}, {squeezed}) + length({squeezed}) - 1] END"


def _rule_links(gold: bool) -> str:
    rules = ", ".join(f"('{r.rule_id}', '{r.source.strip(' ,')}', '{r.target}', '{r.relationship}', '{r.confidence}', '{r.target_field}')" for r in RULES)
    held = lambda t, p: f"(contains({t}, {p}) OR contains({_DENSE.format(t)}, replace({p}, ' ', '')))"
    return f"""{_RECORDS}, g AS (SELECT record_id AS passage_id, verse AS text, pozhppurai, substr(pozhppurai, 1, length(pozhppurai) // 2) AS kurippurai, conv_id % 9 AS book FROM r),
u AS (SELECT * FROM (VALUES {rules}) v(rule_id, s, t, relationship_type, level, target_field)),
h AS (SELECT passage_id, rule_id, relationship_type, {"CASE WHEN target_field = 'kurippurai' AND level <> 'high' THEN 'medium' ELSE level END" if gold else "level"} AS confidence, target_field, s, t, text, CASE target_field WHEN 'kurippurai' THEN kurippurai ELSE pozhppurai END AS whole FROM g, u {"" if gold else "WHERE trim(pozhppurai) <> ''"}),
k AS (SELECT passage_id, rule_id, relationship_type, confidence, target_field, {_span("text", "s", "start")} AS a, {_span("text", "s", "end")} AS b, {_span("whole", "t", "start")} AS c, {_span("whole", "t", "end")} AS d, text, whole FROM h WHERE {held("text", "s")} AND {held("whole", "t")})"""


def _rule_answer(gold: bool) -> str:
    score = "CASE confidence WHEN 'high' THEN 0.96 ELSE 0.82 END" if gold else "CASE confidence WHEN 'high' THEN 0.92 ELSE 0.78 END"
    return f"WITH {_rule_links(gold)} SELECT passage_id, rule_id, relationship_type, confidence, target_field, a AS source_start_char, b AS source_end_char, c AS target_start_char, d AS target_end_char, substr(text, a + 1, b - a) AS source_text, substr(whole, c + 1, d - c) AS target_text, CAST({score} AS DOUBLE) AS score FROM k"


_RULE_COLUMNS = ("passage_id", "rule_id", "relationship_type", "confidence", "target_field", "source_start_char", "source_end_char", "target_start_char", "target_end_char", "source_text", "target_text", "score")


@registered(_rule_answer(False))
def rule_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of reviewed rules, phrases as they are but for white space and punctuation."""
    return goldlinks.rule_links(passages_of(spark, sf_dir), list(RULES)).select(*_RULE_COLUMNS)


@registered(_rule_answer(True))
def gold_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of gold rules, with endings and either commentary field."""
    return goldlinks.rule_links(passages_of(spark, sf_dir), list(RULES), gold=True).select(*_RULE_COLUMNS)


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = links_of(spark, sf_dir).withColumns({"passage_id": F.col("link_id"), "target_end_char": F.col("target_start_char") + F.length("target_text"), "split_parent_id": F.lit("")})
    return rows.withColumn("source_start_char", F.col("turn") * 3).withColumn("source_end_char", F.col("turn") * 3 + 12).drop("conv_id", "turn", "score_margin")


_OLD = "o AS (SELECT link_id, link_id AS passage_id, source_text, target_text, relationship_type, confidence, score, method, review, turn * 3 AS a, turn * 3 + 12 AS b, c, c + length(target_text) AS d FROM b)"


@registered(
    f"""WITH {_rule_links(False)}, {_LINKS.split(", b AS (", 1)[0].replace(_RECORDS, "unused AS (SELECT 1)")}, b AS ({_LINKS.split(", b AS (", 1)[1].split("), n AS", 1)[0]}), {_OLD},
e AS (SELECT o.*, EXISTS (SELECT 1 FROM k WHERE k.passage_id = o.passage_id AND o.a < k.b AND k.a < o.b) AS parent FROM o WHERE NOT regexp_full_match(trim(source_text), '[0-9]+[.)]?')),
z AS (SELECT passage_id, a, b, c, d, relationship_type, confidence, 'rule' AS origin, false AS review FROM k UNION ALL SELECT passage_id, a, b, c, d, relationship_type, confidence, CASE WHEN parent THEN 'parent' ELSE 'carried' END, confidence IN ('low', 'no_link') OR parent FROM e)
SELECT origin, relationship_type, confidence, count(*) AS n, count(*) FILTER (review) AS review FROM z GROUP BY ALL"""
)
def link_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule links over carried baseline links, by origin, relation and confidence."""
    rows = goldlinks.generation(passages_of(spark, sf_dir), _baseline(spark, sf_dir), list(RULES), 3)
    origin = F.when(F.col("method").startswith("focused"), "rule").when(F.coalesce("split_parent_id", F.lit("")) != "", "parent").otherwise("carried")
    return rows.groupBy(origin.alias("origin"), "relationship_type", "confidence").agg(F.count("*").alias("n"), F.count_if("manual_review_required").alias("review"))


@registered(f"""WITH {_rule_links(True)}, v AS (SELECT *, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS level FROM k),
w AS (SELECT *, (SELECT count(*) FROM v y WHERE y.passage_id = v.passage_id AND v.a <= y.a AND y.b <= v.b AND (y.a, y.b) <> (v.a, v.b)) AS held FROM v)
SELECT passage_id, a AS source_start_char, b AS source_end_char, max(level) AS level, count(*) FILTER (true) > 0 AS present FROM w WHERE held < 2 GROUP BY ALL""")
def primary_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean table of gold links: no parents of two or more spans, the best of each source span."""
    passages = passages_of(spark, sf_dir)
    rows = goldlinks.primary(goldlinks.rule_links(passages, list(RULES), gold=True), passages)
    return rows.select("passage_id", "source_start_char", "source_end_char", (goldlinks.confidence_rank() - 1).cast("int").alias("level"), F.lit(True).alias("present"))


@registered(f"""WITH {_LINKS} SELECT link_id, CASE WHEN trim(target_text) = '' THEN 'empty_pozhippurai' ELSE 'unresolved_link' END AS reason FROM p WHERE NOT linked""")
def secondary_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that link nothing, with why."""
    return goldlinks.secondary(_baseline(spark, sf_dir), passages_of(spark, sf_dir)).select("link_id", F.col("secondary_table_reason").alias("reason"))


@registered(f"""WITH {_LINKS}, {_OLD}, y AS (SELECT o.*, r.verse, CASE WHEN b.target_field = 'kurippurai' THEN substr(r.pozhppurai, 1, length(r.pozhppurai) // 2) ELSE r.pozhppurai END AS whole FROM o JOIN r ON r.record_id = o.passage_id JOIN b ON b.link_id = o.link_id)
SELECT code, count(*) AS n FROM (
  SELECT 'invalid_bounds' AS code FROM y WHERE b > length(verse) UNION ALL SELECT 'span_mismatch' FROM y WHERE b <= length(verse) AND substr(verse, a + 1, b - a) <> source_text
  UNION ALL SELECT 'invalid_bounds' FROM y WHERE d > length(whole) UNION ALL SELECT 'span_mismatch' FROM y WHERE d <= length(whole) AND substr(whole, c + 1, d - c) <> target_text
) GROUP BY code""")
def link_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the baseline's offsets."""
    return goldlinks.violations(_baseline(spark, sf_dir), passages_of(spark, sf_dir))


@registered(f"""WITH {_rule_links(True)}, t AS (SELECT passage_id, rule_id, target_field, confidence, regexp_extract_all(substr(text, a + 1, b - a), '[\\p{{L}}\\p{{N}}_]+|[^\\s]') AS x, regexp_extract_all(substr(whole, c + 1, d - c), '[\\p{{L}}\\p{{N}}_]+|[^\\s]') AS y FROM k WHERE confidence IN ('high', 'medium'))
SELECT side, tag, count(*) AS n FROM (
  SELECT 'paadal' AS side, CASE WHEN i = 1 THEN 'B-PAADAL_SPAN' ELSE 'I-PAADAL_SPAN' END AS tag FROM (SELECT unnest(range(1, len(x) + 1)) AS i FROM t)
  UNION ALL SELECT target_field, CASE WHEN i = 1 THEN 'B-POZHIP_SPAN' ELSE 'I-POZHIP_SPAN' END FROM (SELECT target_field, unnest(range(1, len(y) + 1)) AS i FROM t)
) GROUP BY ALL""")
def training_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged tokens of positive gold links, counted by side and tag."""
    rows = goldlinks.training_tokens(goldlinks.rule_links(passages_of(spark, sf_dir), list(RULES), gold=True))
    return rows.groupBy("side", "tag").agg(F.count("*").alias("n"))


# --- cleaning -----------------------------------------------------------------------------------------------------------

SCOPE = [0, 1, 2, 3, 4, 5, 6]
_LATIN = lambda text: F.regexp_count(text, F.lit("[A-Za-z]"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = goldlinks.rule_links(passages_of(spark, sf_dir), list(RULES), gold=True)
    texts = passages_of(spark, sf_dir).select("passage_id", "book", F.col("text").alias("full_source"), F.col("pozhppurai").alias("full_target"))
    return links.join(texts, "passage_id").withColumn("source_field", F.when(F.length("passage_id") % 4 == 0, "other").otherwise("paadal_text"))


@registered(f"""WITH {_rule_links(True)}, l AS (SELECT k.*, g.book, g.pozhppurai AS full_target, CASE WHEN length(passage_id) % 4 = 0 THEN 'other' ELSE 'paadal_text' END AS source_field, trim(substr(k.text, a + 1, b - a)) AS st, trim(substr(whole, c + 1, d - c)) AS tt FROM k JOIN g USING (passage_id))
SELECT reason, count(*) AS n FROM (
  SELECT 'not_main_scope' AS reason FROM l WHERE book > 6 UNION ALL SELECT 'source_field_not_paadal_text' FROM l WHERE source_field <> 'paadal_text' UNION ALL SELECT 'target_field_not_pozhippurai' FROM l WHERE target_field <> 'pozhppurai'
  UNION ALL SELECT 'target_offset_mismatch' FROM l WHERE d > length(full_target) OR substr(full_target, c + 1, d - c) <> substr(whole, c + 1, d - c)
) GROUP BY reason""")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why gold links are not in the clean pool, counted by reason."""
    _, lost = cleaning.candidate_pool(_pool(spark, sf_dir), SCOPE, _LATIN)
    return cleaning.reason_counts(lost)


@registered(f"""WITH {_rule_links(True)}, l AS (SELECT DISTINCT k.passage_id FROM k JOIN g USING (passage_id) WHERE book <= 6 AND length(k.passage_id) % 4 <> 0 AND target_field = 'pozhppurai')
SELECT book, count(*) FILTER (trim(pozhppurai) = '') AS true_missing_pozhippurai, count(*) FILTER (trim(pozhppurai) <> '') AS usable_pozhippurai_but_no_clean_link FROM g WHERE book <= 6 AND (trim(pozhppurai) = '' OR passage_id NOT IN (SELECT passage_id FROM l)) GROUP BY book""")
def missing_commentary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages without commentary, and with one but no clean link, by book."""
    kept, _ = cleaning.candidate_pool(_pool(spark, sf_dir), SCOPE, _LATIN)
    return cleaning.coverage_by_book(cleaning.missing_commentary(passages_of(spark, sf_dir), kept, SCOPE))


@registered("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, raw, doc_id % 5 = 0 AS shifted, trim(regexp_replace(raw, '[\\s]+', ' ', 'g')) AS n FROM l WHERE regexp_matches(raw, '[^\\s]')),
q AS (SELECT *, regexp_extract_all(n, '[A-Za-z0-9]+') AS k, length(n) - length(regexp_replace(n, '[A-Za-z]', '', 'g')) AS letters FROM s)
SELECT CASE WHEN NOT shifted AND w IS NULL THEN 'keep' ELSE 'reject' END AS quality_status, coalesce(w, CASE WHEN len(k) = 1 THEN 'short_but_valid_single_token' WHEN len(k) <= 2 THEN 'very_short_span' ELSE 'clean' END) || CASE WHEN shifted THEN '|offset_mismatch' ELSE '' END AS quality_flags, count(*) AS n
FROM (SELECT *, CASE WHEN regexp_full_match(n, '[\\s,.;:!?()\\[\\]{}"\\x27“”‘’\\-–—/\\\\|]+') THEN 'punctuation_only' WHEN len(k) > 0 AND len(list_filter(k, lambda x: NOT regexp_full_match(x, '[0-9]+'))) = 0 THEN 'numeric_only' WHEN letters = 0 THEN 'no_tamil_text' WHEN letters < 2 THEN 'too_few_tamil_chars' END AS w FROM q) GROUP BY ALL""")
def clean_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line spans of all documents by quality; every fifth document's text is shifted, so that its offsets don't match."""
    from corpusloom.operators import spans

    docs = table(spark, sf_dir, "documents").where("not regexp_like(text, '[\\\\x0B\\\\f\\\\r\\\\x1C-\\\\x1E\\\\u0085\\\\u2028\\\\u2029]')")
    lines = spans.line_spans(docs, "doc_id").select(F.col("doc_id").alias("parent_id"), F.lit("paadal_text").alias("field_name"), F.concat_ws("_", "doc_id", "line_no").alias("span_id"), F.col("line_text").alias("text"), "start_char", "end_char")
    parents = docs.select(F.col("doc_id").alias("parent_id"), F.lit("paadal_text").alias("field_name"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\u0001"), "text")).otherwise(F.col("text")).alias("parent_text"), F.lit(1).alias("book"))
    return cleaning.clean_spans(lines, parents, [1], _LATIN).groupBy("quality_status", "quality_flags").agg(F.count("*").alias("n"))


@registered("SELECT code, n, CASE WHEN (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) + (SELECT count(*) FROM nation WHERE n_regionkey % 2 = 0) > 0 THEN 'NEEDS_REVIEW' ELSE 'VALID' END AS status FROM (SELECT 'label_without_document' AS code, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n UNION ALL SELECT 'nation_without_region', (SELECT count(*) FROM nation WHERE n_regionkey % 2 = 0))")
def hierarchy_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of two hierarchies; of the second, every other parent is left out."""
    a = cleaning.orphans("label_without_document", table(spark, sf_dir, "labels"), "doc_id", table(spark, sf_dir, "documents"), "doc_id")
    b = cleaning.orphans("nation_without_region", table(spark, sf_dir, "nation"), "n_regionkey", table(spark, sf_dir, "region").where("r_regionkey % 2 = 1"), "r_regionkey")
    return cleaning.hierarchy([a, b], ["label_without_document", "nation_without_region"])


# --- relations, diagnostics and promotion ------------------------------------------------------------------------------------

THEOLOGY, IMAGE = ("tion", "ung"), ("eau", "ing")
_WORDS = f"list_filter(regexp_split_to_array(sn, '{_BREAK}'), lambda x: x <> '')"


def _has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@registered(f"""WITH {_LINKS} SELECT link_id, CASE WHEN conv_id % 10 = 0 THEN 'glosses_word' WHEN {_has("source_text || ' ' || left(target_text, 5)", THEOLOGY)} THEN 'theological_explanation' WHEN turn % 4 = 0 THEN 'describes_entity' WHEN {_has("source_text || ' ' || left(target_text, 5)", IMAGE)} THEN 'interprets_image'
  WHEN len({_WORDS}) <= 3 THEN 'glosses_word' WHEN len({_WORDS}) >= 7 THEN 'explains_line' ELSE 'explains_phrase' END AS relation FROM p""")
def link_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by votes, hints, entity types and length."""
    rows = cues.prepared(links_of(spark, sf_dir), "source_text")
    joined = F.concat_ws(" ", "source_text", F.substring("target_text", 1, 5))
    types = F.when(F.col("turn") % 4 == 0, F.array(F.lit("DEITY"))).otherwise(F.array(F.lit("OTHER")))
    votes = F.when(F.col("conv_id") % 10 == 0, "glosses_word")
    return rows.select("link_id", linking.relation_of(joined, votes, types, F.size("_source_text_t"), THEOLOGY, IMAGE).alias("relation"))


@registered("""WITH v AS (SELECT doc_id, (doc_id % 7) / 10 AS token_score, (doc_id % 3) / 10 AS char_score, (doc_id % 5) / 10 AS synonym_score, (doc_id % 2) / 10 AS entity_score, (doc_id % 4) / 10 AS containment_score, (doc_id % 11) / 10 AS order_score, (doc_id % 9) / 100 AS score_margin, ['none', 'high', 'medium', 'low', 'low', 'low'][doc_id % 6 + 1] AS level FROM documents)
SELECT doc_id, CASE level WHEN 'none' THEN 'missing_pozhippurai' WHEN 'high' THEN 'strong_link' WHEN 'medium' THEN 'usable_review' ELSE CASE WHEN greatest(token_score, char_score, synonym_score, entity_score, containment_score) = 0 AND order_score > 0 THEN 'order_only_weak_match' WHEN score_margin < 0.03 THEN 'ambiguous_multiple_targets'
  WHEN token_score = 0 AND synonym_score = 0 AND containment_score < 0.15 THEN 'low_lexical_overlap' WHEN entity_score = 0 THEN 'no_shared_entity_anchor' ELSE 'weak_similarity' END END AS label FROM v""")
def link_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostic labels of scored rows."""
    d = F.col("doc_id")
    parts = {"token_score": 7, "char_score": 3, "synonym_score": 5, "entity_score": 2, "containment_score": 4, "order_score": 11}
    rows = table(spark, sf_dir, "documents").select("doc_id", *[(d % m / 10).alias(n) for n, m in parts.items()], (d % 9 / 100).alias("score_margin"), F.lit(0.0).alias("sequence_alignment_bonus"), _pick(("none", "high", "medium", "low", "low", "low"), d).alias("level"))
    return rows.select("doc_id", linking.diagnostic(F.col("level"), F.col("sequence_alignment_bonus")).alias("label"))


#: Phrase families and senses of the prose; fixed values
FAMILY_RULES = (
    promotion.PhraseFamily("crescent_image", "image_family", ("eau", "ver"), ("ment", "sch")), promotion.PhraseFamily("worship_action_result", "theology_family", ("tion", "th"), ("ou", "ing")),
    promotion.PhraseFamily("deity_thalam_entity", "entity_family", ("la", "der"), ("de", "die")), promotion.PhraseFamily("landscape_phrase", "phrase_family", ("en", "an"), ("et", "und", "and")),
)
SENSES = (promotion.Sense("ver", ("ung", "ment")), promotion.Sense("que", ("tion",), "QUE_CONTEXT"), promotion.Sense("the", ("and",), never=True))
_FAMILY = "CASE relationship_type WHEN 'interprets_image' THEN 'image_family' WHEN 'theological_explanation' THEN 'theology_family' WHEN 'describes_entity' THEN 'entity_family' WHEN 'unlinked' THEN 'unknown_family' ELSE 'phrase_family' END"
_MATCHED = "list_filter([" + ", ".join(f"CASE WHEN {_FAMILY} IN ('{x.family}', 'unknown_family') AND {_has('source_text', x.source)} AND {_has('target_text', x.target)} THEN '{x.name}' END" for x in FAMILY_RULES) + "], lambda x: x IS NOT NULL)"


@registered(f"""WITH {_LINKS}, m AS (SELECT *, {_MATCHED} AS fam, source_text || ' ' || target_text AS j FROM p)
SELECT link_id, array_to_string(fam, ',') AS families, CAST(CASE WHEN len(fam) = 0 THEN 0 ELSE round(1000 * least(1, least(0.75, 0.24 + 0.16 * len(fam)) + least(0.2, score / 4)) + 0.0001) / 1000 END AS DOUBLE) AS paraphrase,
  CAST(CASE WHEN (contains(j, 'ver') AND NOT {_has("j", ("ung", "ment"))}) OR (contains(j, 'que') AND NOT contains(j, 'tion')) THEN 0.45 ELSE 1.0 END AS DOUBLE) AS safety,
  CASE WHEN relationship_type = 'unlinked' THEN 'explains_phrase' WHEN {_has("j", ("eau", "sch"))} AND relationship_type IN ('explains_phrase', 'glosses_word') AND len(list_filter(fam, lambda x: ends_with(x, '_image'))) > 0 THEN 'interprets_image'
    WHEN {_has("j", ("tion", "ing"))} AND relationship_type IN ('explains_phrase', 'describes_entity') AND list_contains(fam, 'worship_action_result') THEN 'theological_explanation' WHEN {_has("j", ("la",))} AND relationship_type = 'interprets_image' AND list_contains(fam, 'deity_thalam_entity') THEN 'describes_entity' ELSE relationship_type END AS repaired FROM m""")
def link_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase families, paraphrase score, word senses and repaired relation of every link."""
    rows = links_of(spark, sf_dir).withColumns({"learned_pattern_score": F.col("score"), "anchor_resolver_score": F.lit(0.0), "_m": promotion.matched_families(FAMILY_RULES)})
    _, safety = promotion.word_senses(SENSES)
    fixed = promotion.repaired_relation(F.col("_m"), ("eau", "sch"), ("tion", "ing"), ("la",))
    return rows.select("link_id", F.array_join("_m", ",").alias("families"), (F.round(1000 * promotion.paraphrase_score(F.col("_m")) + 0.0001, 0) / 1000).alias("paraphrase"), safety.alias("safety"), fixed["relation"].alias("repaired"))


_EXAMPLE = "confidence = 'high' AND NOT review AND relationship_type <> 'unlinked' AND target_text <> '' AND source_text <> ''"


@registered(
    f"WITH {_LINKS}, x AS ("
    + " UNION ALL ".join(f"SELECT link_id, '{s}' AS source_phrase, '{t}' AS target_phrase, '{x.family}' AS relationship_family FROM p WHERE {_EXAMPLE} AND {_FAMILY} = '{x.family}' AND contains(source_text, '{s}') AND contains(target_text, '{t}')" for x in FAMILY_RULES for s in x.source for t in x.target)
    + ") SELECT source_phrase, target_phrase, relationship_family, count(*) AS support_count, CASE WHEN count(*) >= 12 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'low' END AS confidence, array_to_string(list_sort(list(link_id))[:8], '|') AS example_link_ids FROM x GROUP BY ALL HAVING count(*) >= 2"
)
def paraphrase_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cues that high links hold together."""
    return promotion.paraphrase_lexicon(links_of(spark, sf_dir), FAMILY_RULES)


@registered(f"""WITH {_LINKS}, m AS (SELECT *, {_MATCHED} AS fam FROM p), e AS (SELECT relationship_type, confidence, review, CASE WHEN len(fam) = 0 THEN 0 ELSE least(0.75, 0.24 + 0.16 * len(fam)) END AS s, unnest(fam) AS pattern_group FROM m),
g AS (SELECT pattern_group, relationship_type, count(*) FILTER (confidence = 'high' AND NOT review) AS support_count, count(*) FILTER (confidence IN ('low', 'medium') AND s < 0.5) AS negative_count FROM e GROUP BY ALL)
SELECT *, CAST(round_even(support_count / (support_count + negative_count), 4) AS DOUBLE) AS precision, CAST(CASE WHEN support_count / (support_count + negative_count) >= 0.9 THEN 0.82 ELSE 0.86 END AS DOUBLE) AS promotion_threshold FROM g WHERE support_count > 0""")
def pattern_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision of phrase families among high and weak links."""
    return promotion.pattern_groups(links_of(spark, sf_dir).withColumns({"learned_pattern_score": F.lit(0.0), "anchor_resolver_score": F.lit(0.0)}), FAMILY_RULES)


_TOKENS = f"list_filter({{}}, lambda x: length(x) >= 3)"


@registered(f"""WITH {_LINKS}, t AS (SELECT *, list_distinct(list_filter(st, lambda x: length(x) >= 3)) AS s3, list_distinct(list_filter(tt, lambda x: length(x) >= 3)) AS t3, 'lex_' || (conv_id % 4) AS rule, 'ART.' || (turn % 3) AS anchor, 'm' || (conv_id % 2) AS seq FROM p),
ex AS (SELECT * FROM t WHERE confidence = 'high' AND NOT review AND relationship_type <> 'unlinked'),
l AS (SELECT relationship_type AS r, part, feature, count(*) AS n FROM (SELECT relationship_type, 'rule' AS part, rule AS feature FROM ex UNION ALL SELECT relationship_type, 'anchor', anchor FROM ex UNION ALL SELECT relationship_type, 'sequence', seq FROM ex UNION ALL SELECT relationship_type, 'source_token', unnest(s3) FROM ex UNION ALL SELECT relationship_type, 'target_token', unnest(t3) FROM ex) GROUP BY ALL),
o AS (SELECT link_id, relationship_type AS r, 'rule' AS part, rule AS feature FROM t UNION ALL SELECT link_id, relationship_type, 'anchor', anchor FROM t UNION ALL SELECT link_id, relationship_type, 'sequence', seq FROM t UNION ALL SELECT link_id, relationship_type, 'source_token', unnest(s3) FROM t UNION ALL SELECT link_id, relationship_type, 'target_token', unnest(t3) FROM t),
h AS (SELECT link_id, part, sum(ln(1 + n)) AS s FROM o JOIN l USING (r, part, feature) WHERE n >= 3 OR part NOT LIKE '%token' GROUP BY ALL),
w AS (SELECT link_id, max(s) FILTER (part = 'rule') AS ha, max(s) FILTER (part = 'anchor') AS hb, max(s) FILTER (part = 'source_token') AS hc, max(s) FILTER (part = 'target_token') AS hd, max(s) FILTER (part = 'sequence') AS he FROM h GROUP BY link_id)
SELECT link_id, CAST(round_even(CAST(least(0.35, coalesce(ha, 0) / 35) + least(0.25, coalesce(hb, 0) / 35) + least(0.15, coalesce(hc, 0) / 35) + least(0.15, coalesce(hd, 0) / 35) + least(0.1, coalesce(he, 0) / 60) + least(0.25, score / 5) AS DOUBLE), 4) AS DOUBLE) AS learned,
  array_to_string(list_filter([CASE WHEN ha IS NOT NULL THEN 'rule' END, CASE WHEN hb IS NOT NULL THEN 'anchor' END, CASE WHEN hc IS NOT NULL OR hd IS NOT NULL THEN 'token' END, CASE WHEN score >= 0.75 THEN 'semantic' END], lambda x: x IS NOT NULL), ',') AS evidence FROM t LEFT JOIN w USING (link_id)""")
def learned_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned scores of links by what high links have taught, in six capped parts."""
    rows = cues.prepared(links_of(spark, sf_dir), "source_text", "target_text")
    long = lambda c: F.filter(F.col(c), lambda x: F.length(x) >= 3)
    parts = {"rule": F.array(F.concat(F.lit("lex_"), F.col("conv_id") % 4)), "anchor": F.array(F.concat(F.lit("ART."), F.col("turn") % 3)), "source_token": long("_source_text_t"), "target_token": long("_target_text_t")}
    sequence = F.concat(F.lit("m"), F.col("conv_id") % 2)
    learned = evaluation.learned_parts(rows.where(promotion.is_example()), "relationship_type", parts, sequence)
    out = evaluation.pattern_scores(rows, "link_id", "relationship_type", parts, learned, sequence, F.col("score"))
    return out.select("link_id", F.col("learned_pattern_score").alias("learned"), F.array_join("evidence", ",").alias("evidence"))


# --- evaluation and the evidence pack ------------------------------------------------------------------------------------------

TERMS = ("the", "tion", "ver")


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    expected = F.struct(
        _pick(("group_by_author", "compare_sources", "unsupported"), d).alias("intent"), _pick(("the", "tion"), d).alias("term"), (d % 4 == 0).alias("expanded"), F.when(d % 5 == 0, "author").alias("group_by"),
        F.when(d % 6 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("required_matched_terms"), (d % 8).alias("min_total_occurrences"), F.when(d % 7 == 0, "g1").otherwise("").alias("top_group_key"), (d % 9 == 0).alias("requires_evidence_samples"),
    )
    observed = F.struct(
        _pick(("group_by_author", "compare_sources", "unsupported"), F.when(d % 13 == 0, d + 1).otherwise(d)).alias("intent"), _pick(("the", "tion"), F.when(d % 17 == 0, d + 1).otherwise(d)).alias("term"), (d % 8 == 0).alias("expanded"), F.when(d % 10 == 0, "author").otherwise("work").alias("group_by"),
        F.when(d % 12 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("matched_terms"), (d % 11).alias("total_occurrences"), F.when(d % 14 == 0, "g1").otherwise("g2").alias("top_group_key"), (d % 2).alias("evidence_samples"),
    )
    return docs.select(d.alias("case_id"), F.col("lang").alias("category"), expected.alias("expected")), docs.where("doc_id % 19 <> 0").select(d.alias("case_id"), observed.alias("observed"))


@registered("""WITH v AS (SELECT doc_id AS d, lang, ['group_by_author', 'compare_sources', 'unsupported'][d % 3 + 1] AS ei, ['the', 'tion'][d % 2 + 1] AS et, d % 4 = 0 AS ee, d % 5 = 0 AS eg, d % 6 = 0 AS em, d % 8 AS en, d % 7 = 0 AS ek, d % 9 = 0 AS es, d % 19 <> 0 AS seen,
  ['group_by_author', 'compare_sources', 'unsupported'][(CASE WHEN d % 13 = 0 THEN d + 1 ELSE d END) % 3 + 1] AS oi, ['the', 'tion'][(CASE WHEN d % 17 = 0 THEN d + 1 ELSE d END) % 2 + 1] AS ot, d % 8 = 0 AS oe, d % 10 = 0 AS og, d % 12 = 0 AS om, d % 11 AS ototal, d % 14 = 0 AS ok, d % 2 AS os FROM documents),
c AS (SELECT *, seen AND oi = ei AS ci, seen AND ot = et AS ct, seen AND oe = ee AS ce, NOT eg OR (seen AND og) AS cg, CASE WHEN seen THEN ototal ELSE 0 END >= en AS cn, NOT ek OR (seen AND ok) AS ck, (seen AND (NOT em OR om)) AS cm, NOT es OR (seen AND os > 0) AS cs FROM v),
k AS (SELECT *, CASE WHEN ei = 'unsupported' THEN CASE WHEN ci THEN 'success' ELSE 'failure' END WHEN ci AND ct AND ce AND cg AND cn AND ck AND cm AND cs THEN 'success' WHEN ci AND ct AND seen AND ototal > 0 THEN 'partial_success' ELSE 'failure' END AS classification FROM c)
SELECT d AS case_id, classification, CASE WHEN classification = 'success' THEN NULL WHEN NOT seen THEN 'architecture_gap' WHEN NOT ci OR NOT ct THEN 'analytics_gap' WHEN ee AND NOT oe THEN 'query_expansion_gap' WHEN NOT cm THEN 'synonym_gap' WHEN ototal < en AND ototal = 0 THEN 'data_gap' WHEN ototal < en THEN 'occurrence_gap'
  WHEN NOT ck THEN 'aggregation_gap' WHEN NOT cg THEN 'metadata_gap' WHEN NOT cs THEN 'occurrence_gap' ELSE 'unknown' END AS failure_type FROM k""")
def analytics_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases checked against observations, with their class and why they failed."""
    return benchmarks.evaluated_cases(*_cases(spark, sf_dir)).select("case_id", "classification", "failure_type")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    requires = F.map_from_arrays(
        F.array(*map(F.lit, ("retrieval", "synonym_expansion", "aggregation", "llm_generation", "cross_corpus"))), F.array(d % 2 == 0, d % 3 == 0, d % 5 == 0, d % 11 == 0, d % 13 == 0)
    )
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("question_id"), F.concat(_pick(tuple("ABCDEFGH"), d), F.lit(". x")).alias("category"), F.coalesce("text", F.lit("")).alias("question"), F.when(d % 7 == 0, "manual_review").otherwise("exact").alias("evaluation_method"), requires.alias("requires")
    )


@registered("""WITH v AS (SELECT doc_id AS d, substr('ABCDEFGH', CAST(doc_id % 8 + 1 AS INT), 1) AS c, contains(text, 'the') OR contains(text, 'tion') OR contains(text, 'ver') AS term FROM documents),
b AS (SELECT *, CASE WHEN d % 13 = 0 OR c = 'H' THEN 'cross-corpus questions' WHEN d % 11 = 0 OR d % 7 = 0 THEN 'unsupported questions' WHEN c = 'G' THEN 'author questions' WHEN c = 'E' THEN 'deity questions' WHEN c = 'D' THEN 'synonym questions' WHEN c = 'C' THEN 'occurrence questions' WHEN d % 5 = 0 THEN 'aggregation questions' ELSE 'ordinary retrieval' END AS category,
  CASE WHEN d % 11 = 0 THEN 'architecture_gap' WHEN d % 13 = 0 THEN 'data_gap' WHEN c = 'F' THEN 'architecture_gap' WHEN d % 3 = 0 AND NOT term THEN 'registry_gap' WHEN d % 7 = 0 THEN 'evaluation_gap' ELSE '' END AS failure_type FROM v),
s AS (SELECT *, CASE failure_type WHEN '' THEN 'success' WHEN 'evaluation_gap' THEN 'partial' ELSE 'failure' END AS status FROM b)
SELECT category, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failure') AS failure, round_even(count(*) FILTER (status = 'success') / count(*), 4) AS success_rate, round_even(count(*) FILTER (status = 'partial') / count(*), 4) AS partial_rate, round_even(count(*) FILTER (status = 'failure') / count(*), 4) AS failure_rate FROM s GROUP BY category""")
def capability_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that can be answered, by category."""
    return benchmarks.rates(benchmarks.evaluated_questions(_questions(spark, sf_dir), TERMS), "status", ("success", "partial", "failure"), "category")


@registered("""WITH v AS (SELECT doc_id AS d, substr('ABCDEFGH', CAST(doc_id % 8 + 1 AS INT), 1) AS c, contains(text, 'the') OR contains(text, 'tion') OR contains(text, 'ver') AS term FROM documents),
b AS (SELECT d, CASE WHEN d % 11 = 0 THEN 'architecture_gap' WHEN d % 13 = 0 THEN 'data_gap' WHEN c = 'F' THEN 'architecture_gap' WHEN d % 3 = 0 AND NOT term THEN 'registry_gap' WHEN d % 7 = 0 THEN 'evaluation_gap' END AS failure_type,
  array_to_string(list_sort(list_filter([CASE WHEN d % 2 = 0 THEN 'retrieval' END, CASE WHEN d % 3 = 0 THEN 'query_expansion' END, CASE WHEN d % 5 = 0 THEN 'occurrence_search' END, CASE WHEN d % 5 = 0 THEN 'aggregation' END], lambda x: x IS NOT NULL)), ',') AS supported_by FROM v)
SELECT CAST(d AS VARCHAR) AS question_id, coalesce(failure_type, '') AS failure_type, supported_by, CAST(CASE failure_type WHEN 'evaluation_gap' THEN 0.68 WHEN 'architecture_gap' THEN 0.88 WHEN 'data_gap' THEN 0.86 WHEN 'registry_gap' THEN 0.84 END AS DOUBLE) AS confidence FROM b""")
def question_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's missing capability, what supports it, and how sure that is."""
    rows = benchmarks.evaluated_questions(_questions(spark, sf_dir), TERMS)
    return rows.select("question_id", "failure_type", F.array_join("supported_by", ",").alias("supported_by"), "confidence")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = links_of(spark, sf_dir).withColumns({"paadal_id": F.col("link_id"), "thirumurai_no": F.col("conv_id") % 9, "pathigam_id": F.col("conv_id"), "target_end_char": F.col("target_start_char") + 5})
    passages = links.select("paadal_id", F.col("source_text").alias("full_paadal_text"), F.col("target_text").alias("full_pozhippurai"))
    return ragpack.evidence_rows(links, passages)


_PATH = "'Thirumurai ' || (conv_id % 9) || ' > Pathigam ' || conv_id || ' > Paadal ' || link_id || ' > source[' || a || ':' || b || '] > pozhippurai[' || coalesce(CAST(c AS VARCHAR), '') || ':' || coalesce(CAST(c + 5 AS VARCHAR), '') || ']'"


@registered(f"""WITH {_LINKS} SELECT 'evidence_rag_' || link_id AS record_id, {_PATH} AS citation_text, sha256('Paadal span:' || chr(10) || source_text || chr(10) || chr(10) || 'Pozhippurai explanation:' || chr(10) || target_text || chr(10) || chr(10) || 'Full Paadal:' || chr(10) || source_text || chr(10) || chr(10) || 'Evidence path:' || chr(10) || {_PATH}) AS chunk_sha256
FROM p WHERE confidence = 'high' AND NOT review AND relationship_type <> 'unlinked'""")
def evidence_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus records of high links, their chunk texts by digest."""
    return ragpack.corpus(_evidence(spark, sf_dir)).select("record_id", "citation_text", F.sha2("chunk_text", 256).alias("chunk_sha256"))


_PLACE = "list_position([" + ", ".join(f"'{k}'" for k in ragpack.CAPABILITIES) + "], relationship_type)"


@registered(f"""WITH {_LINKS}, e AS (SELECT *, row_number() OVER (PARTITION BY relationship_type ORDER BY sha256('qa|' || relationship_type || '|' || link_id || '|' || link_id), link_id) AS nth FROM p WHERE confidence = 'high' AND NOT review AND relationship_type <> 'unlinked'),
q AS (SELECT *, row_number() OVER (ORDER BY {_PLACE}, nth) AS i FROM e WHERE nth <= 3) SELECT 'HC_QA_' || lpad(CAST(i AS VARCHAR), CAST(greatest(3, length(CAST(i AS VARCHAR))) AS INT), '0') AS question_id, relationship_type AS gold_relationship_type, link_id AS gold_link_id FROM q""")
def balanced_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over evidence, three of each relation by a hash."""
    return ragpack.questions(_evidence(spark, sf_dir), 3).select("question_id", "gold_relationship_type", "gold_link_id")


@registered(f"""WITH {_LINKS} SELECT k AS relationship_type, count(link_id) AS paths, count(link_id) >= 20 AS can_support_rag_now FROM (SELECT unnest([{", ".join(f"'{k}'" for k in ragpack.CAPABILITIES)}]) AS k) LEFT JOIN p ON relationship_type = k AND confidence = 'high' AND NOT review GROUP BY k""")
def evidence_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence paths of every capability."""
    return ragpack.capabilities(_evidence(spark, sf_dir)).select("relationship_type", "paths", "can_support_rag_now")
