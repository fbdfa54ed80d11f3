"""Row generators over texts: line and clause spans with code-point offsets, windows of clauses, chunks, index postings."""

from __future__ import annotations

import heapq
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.generate import generated

CLAUSE_END = r"[.!?।;,]+"
CHUNK_TYPES = ("verse_only", "verse_plus_commentary", "metadata_context", "pozhppurai_only", "kurippurai_only")


def _lines():
    def find(text):
        begin = 0
        for number, line in enumerate((text or "").splitlines(keepends=True), 1):
            own = line.splitlines()[0]
            if own.strip():
                yield number, begin, begin + len(own), own
            begin += len(line)

    return find


def line_spans(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no, start_char, end_char, line_text of the non-blank lines of each text.

    All lines are numbered from 1, blank ones too, and end at any line break. A line is whole, with its outer spaces;
    offsets count code points from 0, end exclusive. Each row is a text of its own, also where keys repeat.
    """
    return generated(rows, [key], [text], "line_no bigint, start_char bigint, end_char bigint, line_text string", _lines)


_CLAUSE = re.compile(rf"[^.!?।;,]*{CLAUSE_END}|[^.!?।;,]+")
_BLANK = " \t\n\x0b\f\r"


def _clauses():
    def find(text):
        number = 0
        for m in _CLAUSE.finditer(text or ""):
            if own := m[0].strip(_BLANK):
                number += 1
                start = m.start() + len(m[0]) - len(m[0].lstrip(_BLANK))
                yield number, start, start + len(own), own

    return find


def segment_spans(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, segment_no (from 1), start_char, end_char, segment_text: clauses, each with the punctuation that ends it, trimmed."""
    return generated(rows, [key], [text], "segment_no bigint, start_char bigint, end_char bigint, segment_text string", _clauses)


def segment_windows(segments: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Contiguous windows of one to `most` segments: window_size, segment_no, segment_end_no, start_char, end_char."""
    order = Window.partitionBy(key).orderBy("segment_no")
    ends = [F.struct(F.lit(k + 1).cast("bigint").alias("window_size"), F.lead("segment_no", k).over(order).alias("segment_end_no"), F.lead("end_char", k).over(order).alias("end_char")) for k in range(most)]
    rows = segments.select(key, "segment_no", "start_char", F.array(*ends).alias("ends"))
    return rows.select(key, "segment_no", "start_char", F.inline(F.filter("ends", lambda e: e["segment_end_no"].isNotNull())))


def candidates_near(segments: DataFrame, centre, radius: int) -> DataFrame:
    """Segments that lie within radius characters of a centre."""
    return segments.where((F.col("end_char") > centre - radius) & (F.col("start_char") < centre + radius))


def chunks(records: DataFrame) -> DataFrame:
    """Three typed chunks of each record, and one each for non-empty pozhppurai and kurippurai.

    records: record_id, verse, pozhppurai, kurippurai, metadata (normalised texts).
    """
    both = F.array_join(F.filter(F.array("verse", "pozhppurai", "kurippurai"), lambda x: x != ""), "\n\n")
    texts = {"verse_only": F.col("verse"), "verse_plus_commentary": both, "metadata_context": F.col("metadata"), "pozhppurai_only": F.col("pozhppurai"), "kurippurai_only": F.col("kurippurai")}
    typed = [F.struct(F.lit(k).alias("chunk_type"), tx.normalize_text(texts[k], compose=False).alias("chunk_text")) for k in CHUNK_TYPES]
    optional = F.array(F.lit("pozhppurai_only"), F.lit("kurippurai_only"))
    kept = F.filter(F.array(*typed), lambda c: ~F.array_contains(optional, c["chunk_type"]) | (c["chunk_text"] != ""))
    rows = records.select("record_id", "metadata", F.inline(kept))
    tokens = tx.search_tokens(F.concat_ws(" ", "chunk_text", "metadata"))
    return rows.select(
        F.concat_ws("_", "record_id", "chunk_type").alias("chunk_id"), F.col("record_id").alias("parent_record_id"), "chunk_type", "chunk_text",
        F.length("chunk_text").cast("bigint").alias("char_count"), tx.token_estimate(tx.search_tokens(F.col("chunk_text"))).cast("bigint").alias("token_estimate"),
        tx.unique_terms(tokens).alias("unique_terms"),
    )


def postings(rows: DataFrame, key: str, tokens) -> DataFrame:
    """term, key: the inverted index as rows, each pair once; it is distinct within a row before anything is shuffled."""
    return rows.select(F.explode(F.array_distinct(tokens)).alias("term"), key)


def posting_lists(posted: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """term, block_no, ids (sorted), n: a term's ids in blocks of at most about `block` of them, dealt by a hash of the id.

    A term that a third of all records have is thus many rows of bounded size. Blocks of a term are as many as its records need.
    """
    sizes = posted.groupBy("term").agg(F.ceil(F.count("*") / block).alias("blocks"))
    rows = posted.join(sizes, "term").withColumn("block_no", F.pmod(F.xxhash64(key), F.col("blocks")))
    return rows.groupBy("term", "block_no").agg(F.array_sort(F.collect_set(key)).alias("ids")).withColumn("n", F.size("ids").cast("bigint"))


def _frequent(most: int):
    def make():
        def find(tokens):
            counted = Counter(t for t in tokens or () if len(t) > 1)
            for nth, (term, n) in enumerate(heapq.nsmallest(most, counted.items(), key=lambda x: (-x[1], x[0].encode())), 1):
                yield term, n, nth

        return find

    return make


def keyword_candidates(rows: DataFrame, key: str, tokens, most: int = 30) -> DataFrame:
    """key, term, n, nth: each row's most frequent tokens of more than one character, by count and then term."""
    return generated(rows.select(key, tokens.alias("_tokens")), [key], ["_tokens"], "term string, n bigint, nth bigint", _frequent(most))


def word_counts(rows: DataFrame, tokens, most: int = 3) -> DataFrame:
    """term, n: word n-grams of one to `most` words over all rows."""
    return rows.select(F.explode(tx.word_ngrams(tokens, most)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def rebuilt_spans(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Line spans of several (table, key, text field), as one table with the field's name and a hashed id."""
    out = None
    for rows, key, field in tables:
        spans = line_spans(rows, key, field).select(F.col(key).cast("string").alias("parent_id"), F.lit(field).alias("field_name"), "line_no", "start_char", "end_char", "line_text")
        out = spans if out is None else out.unionByName(spans)
    return out.withColumn("span_id", tx.stable_hash(F.col("parent_id"), F.col("field_name"), F.col("line_no"), F.col("start_char")))


def iob_tokens(rows: DataFrame, key: str, tokens, first, last, label) -> DataFrame:
    """key, token_no, token, tag: B- and I- tags for the tokens from first to last (0-based, inclusive), else O."""
    rows = rows.select(key, first.alias("first"), last.alias("last"), label.alias("label"), F.posexplode(tokens).alias("token_no", "token"))
    tag = F.when(F.col("token_no") == F.col("first"), F.concat(F.lit("B-"), "label")).when((F.col("token_no") > F.col("first")) & (F.col("token_no") <= F.col("last")), F.concat(F.lit("I-"), "label"))
    return rows.select(key, "token_no", "token", F.coalesce(tag, F.lit("O")).alias("tag"))
