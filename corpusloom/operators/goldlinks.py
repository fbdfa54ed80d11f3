"""Links from reviewed rules, generations of links over one another, clean and secondary tables, and their validation.

A passage is a row with passage_id, text, commentary_id and its commentary fields (pozhppurai, kurippurai). Rules are a small
list on the driver; each task goes through them for the passages it reads, and passages never meet each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.find import OUTER, clean_phrase, exact_span, word_span
from corpusloom.functions.generate import generated
from corpusloom.operators import hardening

#: Relations and decisions that reviewers may name, confidences from weak to strong, and fields of a commentary; fixed values
RELATIONSHIPS = ("explains_line", "explains_phrase", "glosses_word", "interprets_image", "theological_explanation", "describes_entity")
CONFIDENCES = ("no_link", "low", "medium", "high")
TARGET_FIELDS = ("pozhppurai", "kurippurai")
CONTENT = r"[஀-௿A-Za-z0-9]"


@dataclass(frozen=True)
class Rule:
    """A reviewed pair of phrases; passage and commentary ids bind it to one passage."""

    rule_id: str
    source: str
    target: str
    relationship: str
    confidence: str
    target_field: str = "pozhppurai"
    passage_id: str = ""
    commentary_id: str = ""
    split_parent_id: str = ""
    note: str = ""


def rule_errors(rules: list[Rule]) -> list[str]:
    """What is wrong with rules, one line each."""
    out = []
    for n, r in enumerate(rules, 1):
        out += [f"rule {n}: unknown {what} {value!r}" for what, value, known in (("relationship", r.relationship, RELATIONSHIPS), ("confidence", r.confidence, CONFIDENCES), ("field", r.target_field, TARGET_FIELDS)) if value not in known]
    return out


_FOUND = (
    "rule_id string, relationship_type string, confidence string, target_field string, source_start_char bigint, source_end_char bigint, target_start_char bigint, target_end_char bigint,"
    " source_text string, target_text string, split_parent_id string, reviewer_note string"
)


def rule_links(passages: DataFrame, rules: list[Rule], gold: bool = False) -> DataFrame:
    """A link for each rule both of whose phrases stand in a passage and its commentary: passage_id, commentary_id, the spans, score, method, link_id.

    Plain rules ask for phrases as they are, but for white space and punctuation, and for a commentary with text; gold rules also take
    case endings and longer words, and may aim at another field.
    """
    find = word_span if gold else exact_span
    wanted = [(r, clean_phrase(r.source), clean_phrase(r.target)) for r in rules]

    def make():
        def links(passage, commentary, text, *fields):
            by_field = dict(zip(TARGET_FIELDS, fields, strict=True))
            if not gold and not (by_field["pozhppurai"] or "").strip():
                return
            for rule, source, target in wanted:
                if rule.passage_id and str(passage) != rule.passage_id or rule.commentary_id and str(commentary) != rule.commentary_id:
                    continue
                whole = by_field[rule.target_field] or ""
                if (a := find(text or "", source)) and (b := find(whole, target)):
                    level = rule.confidence
                    if gold and rule.target_field == "kurippurai" and level != "high":
                        level = "medium"
                    yield rule.rule_id, rule.relationship, level, rule.target_field, a[0], a[1], b[0], b[1], text[a[0] : a[1]], whole[b[0] : b[1]], rule.split_parent_id, rule.note

        return links

    keep = ["passage_id", "commentary_id"]
    rows = generated(passages, keep, [*keep, "text", *TARGET_FIELDS], _FOUND, make)
    high = F.col("confidence") == "high"
    parts = ("passage_id", "source_start_char", "source_end_char", *(("target_field",) if gold else ()), "target_start_char", "target_end_char", "relationship_type")
    named = F.concat(F.lit("v4_gold_"), "rule_id") if gold else F.col("rule_id")
    return rows.withColumns({"score": F.when(high, 0.96).otherwise(0.82) if gold else F.when(high, 0.92).otherwise(0.78), "rule_ids_applied": F.array(named)}).select(
        F.concat(F.lit("ppl_v4_" if gold else "ppl_v3_"), tx.stable_hash(*map(F.col, parts), named)).alias("link_id"), "*",
        F.lit("v4_gold_seed_exact_or_morphology_match" if gold else "focused_qa_rule_exact_span_v3").alias("method"), F.lit(False).alias("manual_review_required"),
        (F.concat(F.lit("v4 gold seed matched using "), "target_field", F.lit(".")) if gold else F.lit("Focused QA rule matched.")).alias("diagnostic_note"),
    )


def overlaps_any(links: DataFrame, others: DataFrame) -> DataFrame:
    """links with split_parent: whether a link of others has characters of its source; both sorted by passage and start, a running maximum each way."""
    own = links.select("link_id", "passage_id", F.col("source_start_char").alias("a"), F.col("source_end_char").alias("b"), F.lit(0).alias("other"))
    both = own.unionByName(others.select(F.lit(None).cast("string").alias("link_id"), "passage_id", F.col("source_start_char").alias("a"), F.col("source_end_char").alias("b"), F.lit(1).alias("other")))
    # At one place, empty own spans stand before the others and longer ones after them.
    place = F.when(F.col("other") == 1, 1).when(F.col("a") == F.col("b"), 0).otherwise(2)
    order = Window.partitionBy("passage_id").orderBy("a", place, "b")
    reached = F.max(F.when(F.col("other") == 1, F.col("b"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    comes = F.min(F.when(F.col("other") == 1, F.col("a"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    hit = both.withColumn("split_parent", F.coalesce(reached > F.col("a"), F.lit(False)) | F.coalesce(comes < F.col("b"), F.lit(False))).where("other = 0")
    flags = hit.groupBy("link_id").agg(F.max("split_parent").alias("split_parent"))
    return links.join(flags, "link_id", "left").withColumn("split_parent", F.coalesce("split_parent", F.lit(False)))


def carried(links: DataFrame, over: DataFrame, generation: int) -> DataFrame:
    """Links of the generation before, as baseline links of this one: no numbering lines, new ids, and parents of what `over` links marked for review."""
    prefix, method = ("ppl_v3_base_", "v2_baseline_carried_forward_v3") if generation == 3 else ("ppl_v4_base_", "v3_baseline_carried_forward_v4")
    rows = overlaps_any(links.where(~tx.is_numbering(F.col("source_text"))), over)
    parent = F.col("split_parent")
    note = "Broad v2 parent overlaps a focused QA split/phrase rule; keep for diagnostics, not positive training." if generation == 3 else "Broad v3 parent overlaps a v4 gold phrase; keep for diagnostics, not positive training."
    level = F.when(F.col("confidence") == "none", "no_link").otherwise(F.col("confidence"))
    review = (level.isin("low", "no_link") if generation == 3 else F.col("manual_review_required")) | parent
    relation = F.when(F.col("relationship_type").isin(*RELATIONSHIPS), F.col("relationship_type")).otherwise("unlinked") if generation == 3 else F.col("relationship_type")
    new = {
        "link_id": F.concat(F.lit(prefix), tx.stable_hash(F.col("link_id"), F.col("passage_id"), F.col("source_start_char"))), "split_parent_id": F.when(parent, F.col("link_id")).otherwise("" if generation == 3 else F.col("split_parent_id")),
        "confidence": level if generation == 3 else F.col("confidence"), "relationship_type": relation, "manual_review_required": review,
        "diagnostic_note": F.when(parent, note).otherwise(F.col("diagnostic_note")), "method": F.lit(method),
    }
    return rows.withColumns(new).drop("split_parent")


def confidence_rank() -> Column:
    return F.greatest(F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.col("confidence")), F.lit(1))


def deduped(links: DataFrame) -> DataFrame:
    """The best link of each pair of spans and relation, by confidence, score, and then the first id."""
    order = Window.partitionBy("passage_id", "source_start_char", "source_end_char", "target_start_char", "target_end_char", "relationship_type").orderBy(F.desc(confidence_rank()), F.desc("score"), "link_id")
    return links.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def generation(passages: DataFrame, before: DataFrame, rules: list[Rule], number: int) -> DataFrame:
    """Links of generation 3 (rules over the baseline) or 4 (gold rules over generation 3): found ones, and carried ones beside them."""
    found = rule_links(passages, rules, gold=number == 4)
    kept = carried(before, found, number)
    return deduped(found.unionByName(kept, allowMissingColumns=True))


def is_positive() -> Column:
    """Links fit for training."""
    return F.col("relationship_type").isin(*RELATIONSHIPS) & F.col("confidence").isin("high", "medium") & ~F.col("manual_review_required") & (F.coalesce("target_text", F.lit("")) != "")


def has_content(column: Column) -> Column:
    return F.coalesce(column.rlike(CONTENT), F.lit(False))


def trimmed_span(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end, text) of a span without outer spaces and punctuation; empty where its offsets lie outside of the text."""
    inside = (start >= 0) & (end >= start) & (end <= F.length(text))
    cut = F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    outer = "[" + "".join("\\" + c if c in "-\\]^" else c for c in OUTER) + "]"
    left = F.regexp_replace(cut, f"^{outer}+", "")
    own = F.regexp_replace(left, f"{outer}+$", "")
    begin = start + F.length(cut) - F.length(left)
    return F.when(inside, F.struct(begin.cast("bigint").alias("start"), (begin + F.length(own)).cast("bigint").alias("end"), own.alias("text"))).otherwise(
        F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.lit("").alias("text"))
    )


def parent_keys(links: DataFrame) -> DataFrame:
    """link_id of linked rows that are split parents, or whose source span holds two or more strictly smaller ones of their passage.

    Distinct spans are counted and then nested by 64-character cells, so that a passage's links never meet all at once.
    """
    rows = links.where(hardening.is_linked())
    spans = rows.groupBy("passage_id", F.col("source_start_char").alias("a"), F.col("source_end_char").alias("b")).agg(F.count("*").alias("n"))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("a") / 64), F.floor(F.greatest(F.col("b") - 1, F.col("a")) / 64))))
    small = spans.select(F.col("passage_id").alias("p"), F.floor(F.col("a") / 64).alias("c"), F.col("a").alias("x"), F.col("b").alias("y"), F.col("n").alias("m"))
    inside = (F.col("passage_id") == F.col("p")) & (F.col("cell") == F.col("c")) & (F.col("a") <= F.col("x")) & (F.col("y") <= F.col("b")) & ~((F.col("a") == F.col("x")) & (F.col("b") == F.col("y")))
    wide = cells.join(small, inside).groupBy("passage_id", "a", "b").agg(F.sum("m").alias("held")).where("held >= 2")
    held = rows.join(wide.select("passage_id", F.col("a").alias("source_start_char"), F.col("b").alias("source_end_char")), ["passage_id", "source_start_char", "source_end_char"]).select("link_id")
    return held.unionByName(rows.where("coalesce(split_parent_id, '') <> ''").select("link_id")).distinct()


def primary(links: DataFrame, passages: DataFrame) -> DataFrame:
    """The clean table: linked rows that are no parents, with trimmed spans and content on both sides, the best of each source span."""
    rows = links.where(hardening.is_linked()).join(parent_keys(links), "link_id", "left_anti").join(passages.select("passage_id", F.col("text").alias("_text"), *[F.col(f).alias(f"_{f}") for f in TARGET_FIELDS]), "passage_id")
    target = F.when(F.col("target_field") == "kurippurai", F.col("_kurippurai")).otherwise(F.col("_pozhppurai"))
    rows = rows.withColumns({"_s": trimmed_span(F.col("_text"), F.col("source_start_char"), F.col("source_end_char")), "_t": trimmed_span(target, F.col("target_start_char"), F.col("target_end_char"))})
    rows = rows.where(has_content(F.col("_s.text")) & has_content(F.col("_t.text")))
    names = {f"{side}_{what}": F.col(f"_{side[0]}.{part}") for side in ("source", "target") for what, part in (("start_char", "start"), ("end_char", "end"), ("text", "text"))}
    rows = rows.withColumns(names | {"cleaning_status": F.lit("primary_clean_link")}).drop("_s", "_t", "_text", *[f"_{f}" for f in TARGET_FIELDS])
    order = Window.partitionBy("passage_id", "source_start_char", "source_end_char").orderBy(F.desc(confidence_rank()), F.desc("score"), "manual_review_required", F.desc(F.col("method").startswith("v4_gold")), "link_id")
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def secondary(links: DataFrame, passages: DataFrame) -> DataFrame:
    """Rows that link nothing, once for each source span, with why: no commentary, or none found in it."""
    order = Window.partitionBy("passage_id", "source_start_char", "source_end_char", "commentary_id").orderBy("link_id")
    rows = links.where(~hardening.is_linked()).withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    rows = rows.join(passages.select("passage_id", F.col("pozhppurai").alias("_p")), "passage_id", "left")
    return rows.withColumn("secondary_table_reason", F.when(tx.missing(F.col("_p")).isNull(), "empty_pozhippurai").otherwise("unresolved_link")).drop("_p")


def violations(links: DataFrame, passages: DataFrame, clean: bool = False) -> DataFrame:
    """code, n of what is wrong: unknown relations, spans out of bounds or of another text, repeated ids; with clean also repeated source spans, unlinked rows and rows without content."""
    rows = links.join(passages.select("passage_id", F.col("text").alias("_text"), *[F.col(f).alias(f"_{f}") for f in TARGET_FIELDS]), "passage_id", "left")
    whole = F.coalesce(F.when(F.col("target_field") == "kurippurai", F.col("_kurippurai")).otherwise(F.col("_pozhppurai")), F.lit(""))
    source = F.coalesce("_text", F.lit(""))
    a, b, c, d = (F.col(x) for x in ("source_start_char", "source_end_char", "target_start_char", "target_end_char"))
    out = lambda text, x, y: (F.coalesce(x, F.lit(0)) < 0) | (F.coalesce(y, F.lit(0)) < F.coalesce(x, F.lit(0))) | (F.coalesce(y, F.lit(0)) > F.length(text))
    other = lambda text, x, y, own: ~F.substring(text, (F.coalesce(x, F.lit(0)) + 1).cast("int"), (F.coalesce(y, F.lit(0)) - F.coalesce(x, F.lit(0))).cast("int")).eqNullSafe(own)
    bad_source, bad_target = out(source, a, b), c.isNotNull() & out(whole, c, d)
    codes = [
        ("invalid_relationship", ~F.col("relationship_type").isin(*RELATIONSHIPS, "unlinked")), ("invalid_bounds", bad_source), ("invalid_bounds", bad_target),
        ("span_mismatch", ~bad_source & other(source, a, b, F.col("source_text"))), ("span_mismatch", c.isNotNull() & ~bad_target & other(whole, c, d, F.col("target_text"))),
    ]
    if clean:
        codes += [("unlinked_row", ~hardening.is_linked()), ("punctuation_only_row", ~has_content(F.col("source_text")) | ~has_content(F.col("target_text")))]
    each = rows.select(F.explode(F.array_compact(F.array(*[F.when(held, code) for code, held in codes]))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    twice = links.groupBy("link_id").count().where("count > 1").agg(F.lit("duplicate_link_id").alias("code"), F.count("*").alias("n")).where("n > 0")
    out = each.unionByName(twice)
    if clean:
        spans = links.groupBy("passage_id", "source_start_char", "source_end_char").count().where("count > 1").agg(F.lit("duplicate_source_span").alias("code"), F.count("*").alias("n")).where("n > 0")
        out = out.unionByName(spans)
    return out


def training_tokens(links: DataFrame) -> DataFrame:
    """link_id, side, token_no, token, tag, relationship_type, confidence of positive links: the rows of a tagged training file."""
    side = F.when(F.col("target_field") == "kurippurai", "kurippurai").otherwise("pozhppurai")
    cut = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)[\w஀-௿]+|[^\s]"), F.lit(0))
    both = F.array(F.struct(F.lit("paadal").alias("side"), F.lit("PAADAL_SPAN").alias("label"), cut(F.col("source_text")).alias("tokens")), F.struct(side.alias("side"), F.lit("POZHIP_SPAN").alias("label"), cut(F.col("target_text")).alias("tokens")))
    rows = links.where(is_positive()).select("link_id", "relationship_type", "confidence", F.inline(both))
    rows = rows.select("link_id", "side", "label", "relationship_type", "confidence", F.posexplode("tokens").alias("token_no", "token"))
    return rows.withColumn("tag", F.concat(F.when(F.col("token_no") == 0, "B-").otherwise("I-"), "label")).drop("label")
