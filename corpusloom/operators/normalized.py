"""Normalised records and tables: one shape for all corpora and categories, table rows by kind, and what normalising changed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.records import alias_of

UNIFIED, CATEGORY, LANGUAGE = "unified-thirumurai-v1", "website-corpus-v2", "ta"
#: Fields that a category's records have, and the one that gives their content; fixed values
CATEGORY_FIELDS = {
    "sangam_literature": (("poem_no", "thinai", "thurai", "colophon", "author", "commentary_url"), "verse_text"),
    "grammar": (("rule_no", "rule_text", "explanation_text", "section_id", "chapter_id", "commentary_url"), "rule_text"),
    "twentieth_century_prose": (("book_id", "work_id", "chapter_id", "section_id", "title", "author"), None),
}
MULTILINE = {"paadalgal": ("paadal_text",), "commentaries": ("kurippurai", "pozhppurai")}


@dataclass(frozen=True)
class Corpus:
    """What a corpus says of all its records; author, where given, is that of every record."""

    corpus_id: str
    number: int
    title: str
    author: str = ""
    aliases: dict[str, str] = field(default_factory=dict)
    prefix: str = "rec"


def _text(rows: DataFrame, *names: str) -> Column:
    """The first of the columns that is there and not blank, stripped; else empty."""
    return F.coalesce(*[tx.missing(tx.strip(F.col(n).cast("string"))) for n in names if n in rows.columns], F.lit(""))


def unified(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """Records of a corpus in the shape that all corpora share; ids that a source lacks are made of corpus, hymn and song."""
    t = lambda *names: _text(rows, *names)
    author = F.lit(corpus.author) if corpus.author else alias_of(t("author"), corpus.aliases)
    hymn, song = t("hymn_id"), t("song_no")
    made = F.concat(F.lit(f"{corpus.prefix}_{corpus.number:02d}_"), hymn, F.lit("_"), song)
    own = lambda *names, default: F.coalesce(tx.missing(t(*names)), default)
    citation = F.concat(author, F.lit(f", {corpus.title}, "), t("hymn_title"), F.lit(", "), song, F.lit("."))
    return rows.select(
        F.lit(UNIFIED).alias("schema_version"), own("record_id", "canonical_id", default=made).alias("record_id"), F.lit(corpus.corpus_id).alias("corpus_id"), F.lit(corpus.number).alias("thirumurai_no"),
        F.lit(corpus.title).alias("canonical_title"), author.alias("author"), author.alias("nayanmar"), hymn.alias("hymn_id"), hymn.alias("pathigam_id"), song.alias("song_no"), t("verse_index_in_hymn").alias("verse_no"),
        t("hymn_title").alias("title"), t("hymn_location").alias("place"), t("verse_text_normalized", "verse_text").alias("verse_text"), t("pozhppurai_normalized", "pozhppurai").alias("pozhppurai"),
        t("kurippurai_normalized", "kurippurai").alias("kurippurai"), t("hymn_url").alias("source_url"), t("commentary_url").alias("commentary_url"), t("author").alias("original_author"), t("pann").alias("pann"),
        own("verse_id", default=F.concat(made, F.lit("_verse"))).alias("verse_id"), own("citation_text", default=citation).alias("citation_text"),
    )


def by_category(rows: DataFrame) -> DataFrame:
    """Records of any category in its schema: every field stripped, dictionary entries with their definition for content, and a category's own fields always there."""
    t = lambda *names: _text(rows, *names)
    entry = t("record_type") == "dictionary_entry"
    definition = F.coalesce(tx.missing(t("definition")), t("content_text", "verse_text"))
    content = F.when(entry, definition)
    fields: dict[str, Column] = {}
    for category, (names, source) in CATEGORY_FIELDS.items():
        if source:
            content = F.when(t("category_id") == category, t(source)).otherwise(content)
        fields |= {n: t(n) for n in names}
    kind = F.when(t("category_id") == "twentieth_century_prose", "prose_section").otherwise(t("record_type"))
    out = {
        "schema_version": F.lit(CATEGORY), "language": F.coalesce(tx.missing(t("language")), F.lit(LANGUAGE)), "content_text": F.coalesce(content, t("content_text", "verse_text")), "verse_text": t("verse_text"),
        "source_url": t("source_url"), "parser_family": t("parser_family"), "record_type": kind, "entry_headword": F.when(entry, t("entry_headword")).otherwise(""), "definition": F.when(entry, definition).otherwise(""),
        "part_of_speech": F.when(entry, t("part_of_speech")).otherwise(""),
    }
    return rows.withColumns(out | {n: c for n, c in fields.items() if n not in out})


def table_row(rows: DataFrame, table: str, inline: tuple[str, ...] = (), compose: bool = True) -> DataFrame:
    """Rows of a table with inline fields on one line, multi-line fields by lines, and tokens of verses."""
    out = {c: tx.normalize_inline(F.coalesce(c, F.lit("")), compose) for c in inline if c in rows.columns}
    out |= {c: tx.normalize_multiline(F.coalesce(c, F.lit("")), compose) for c in MULTILINE.get(table, ()) if c in rows.columns}
    rows = rows.withColumns(out) if out else rows
    return rows.withColumn("tokenized_paadal", tx.verse_tokens(F.col("paadal_text"))) if table == "paadalgal" and "paadal_text" in rows.columns else rows


def newline_count(rows: DataFrame, *fields: str) -> DataFrame:
    """One row: the number of line breaks in the fields of all rows."""
    own = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    return rows.agg(F.coalesce(F.sum(sum((F.coalesce(own(c), F.lit(0)) for c in fields), F.lit(0))), F.lit(0)).cast("bigint").alias("newlines"))
