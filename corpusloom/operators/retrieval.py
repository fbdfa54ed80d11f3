"""Lexical, semantic and hybrid retrieval for a table of queries at once, with query expansion.

Queries are a stated set that goes to the records in passes of bounded size; records are scored where they are read, and only the best
of each task and query are shuffled. Every ranking ends in a unique key.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions import text as tx
from corpusloom.functions.generate import bounded_batches

#: Weight of a query token found in a field, most telling first; fixed values
FIELD_WEIGHTS = {"verse": 700, "pozhppurai": 600, "kurippurai": 500, "search_text": 400, "metadata": 300}
EXACT_CHUNK, EXACT_RECORD, EXACT_SONG, EXACT_HYMN, EXACT_TITLE, AVAILABILITY = 10000, 9500, 9000, 8500, 8000, 7500
PER_FILTER, CHUNK_TEXT = 200, 100
LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 0.65, 0.35
OVERFETCH = 10
#: Fields whose exact match, or whose text match, raises a hybrid score; fixed values
EXACT_FIELDS = ("exact_chunk_id", "exact_record_id", "exact_song_no", "exact_hymn_id", "exact_hymn_title")
TEXT_FIELDS = ("verse", "pozhppurai", "kurippurai", "search_text", "chunk_text")
SUPPORTED_FILTERS = ("song_no", "hymn_id", "author", "pann", "extraction_status", "commentary_available")


def passes_filters(filters: dict[str, object]) -> Column:
    """All filters hold, compared as texts; booleans are written True and False."""
    held = F.lit(True)
    for key, value in filters.items():
        own = F.col(key).cast("string")
        held = held & F.coalesce(own == (str(value).lower() if isinstance(value, bool) else str(value)), F.lit(False))
    return held


def supported(filters: dict[str, object]) -> dict[str, object]:
    """The filters that lexical search knows; it leaves others out, unlike semantic search."""
    return {k: v for k, v in filters.items() if k in SUPPORTED_FILTERS}


#: Most query terms, with the queries that have them, that one pass over the records carries.
PASS_TERMS = 1 << 20


def _passes(queries: DataFrame) -> Iterator[tuple[list, list[str], np.ndarray, np.ndarray]]:
    """Queries in passes of bounded size: their ids, all terms, and of term t the queries owners[starts[t] : starts[t + 1]]."""
    ids, pairs = [], []

    def packed():
        terms = sorted({t for t, _ in pairs})
        place = {t: n for n, t in enumerate(terms)}
        own = np.array(sorted((place[t], q) for t, q in pairs), np.int64).reshape(-1, 2)
        return ids, terms, np.searchsorted(own[:, 0], np.arange(len(terms) + 1)), own[:, 1]

    for row in queries.select("query_id", F.array_distinct(tx.search_tokens(F.col("query"))).alias("terms")).toLocalIterator():
        pairs += [(t, len(ids)) for t in row.terms or ()]
        ids.append(row.query_id)
        if len(pairs) >= PASS_TERMS:
            yield packed()
            ids, pairs = [], []
    if ids:
        yield packed()


def lexical_topk(queries: DataFrame, records: DataFrame, k: int, weights: dict[str, int] = FIELD_WEIGHTS) -> DataFrame:
    """query_id, rank, record_id, score: the k best records of each query by weight x number of distinct query tokens found in each field.

    queries: query_id, query; a stated set, read in passes of bounded size. records: record_id and the fields. A record is scored
    where it is read, and a task hands on its k best of each query only, so a term that all records have costs no shuffle.
    """
    bounded_batches(records.sparkSession)
    fields, points = list(weights), list(weights.values())
    tokens = records.select("record_id", *[F.array_distinct(tx.search_tokens(F.col(f))).alias(f) for f in fields])
    query_kind, record_kind = queries.schema["query_id"].dataType, records.schema["record_id"].dataType
    schema = T.StructType([T.StructField("query_id", query_kind), T.StructField("record_id", record_kind), T.StructField("score", T.LongType())])
    out = queries.sparkSession.createDataFrame([], schema)
    for ids, terms, starts, owners in _passes(queries):

        def score(batches: Iterator[pa.RecordBatch], ids=ids, terms=terms, starts=starts, owners=owners) -> Iterator[pa.RecordBatch]:
            place = {t: n for n, t in enumerate(terms)}
            best: list[list] = [[] for _ in ids]
            for batch in batches:
                names = batch.column(0).to_pylist()
                columns = [batch.column(1 + n).to_pylist() for n in range(len(fields))]
                for row, name in enumerate(names):
                    total = np.zeros(len(ids), np.int64)
                    for column, weight in zip(columns, points, strict=True):
                        own = [owners[starts[n] : starts[n + 1]] for t in column[row] or () if (n := place.get(t)) is not None]
                        if own:
                            total += weight * np.bincount(np.concatenate(own), minlength=len(ids))
                    for q in np.flatnonzero(total).tolist():
                        entry = (int(total[q]), _Late(name))
                        if len(best[q]) < k:
                            heapq.heappush(best[q], entry)
                        elif entry > best[q][0]:
                            heapq.heapreplace(best[q], entry)
            rows = [(q, e[1].value, e[0]) for q, own in zip(ids, best, strict=True) for e in own]
            made = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows, strict=True) if rows else ([], [], []), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(made, ["query_id", "record_id", "score"])

        out = out.unionByName(tokens.mapInArrow(score, schema))
    return top_k(out, k, "score", "record_id")


class _Late:
    """A key that is smaller the later it comes in order, so that of equal scores the earliest key is kept."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other) -> bool:
        return _ordered(self.value) > _ordered(other.value)

    def __eq__(self, other) -> bool:
        return self.value == other.value


def _ordered(value):
    return value.encode() if isinstance(value, str) else value


def top_k(scored: DataFrame, k: int, by: str, *ties: str, of: str = "query_id") -> DataFrame:
    """The k best rows of each query, ranked from 1, by descending score and ascending ties."""
    order = Window.partitionBy(of).orderBy(F.desc(by), *ties)
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def lexical_search(query: str, records: DataFrame, chunks: DataFrame, filters: dict[str, object] | None = None, k: int = 10) -> DataFrame:
    """rank, score, record_id, chunk_id, matched_fields of one query.

    Candidates are the union of what tokens, ids and key filters find, or all records where that is none; filters then all hold.
    records: record_id, verse, pozhppurai, kurippurai, search_text, metadata, song_no, hymn_id, hymn_title, rank_key and filter columns.
    chunks: chunk_id, parent_record_id, unique_terms, rank_key.
    """
    filters = supported(filters or {})
    tokens = F.array_distinct(tx.search_tokens(F.lit(query)))
    chunk_ref = re.search(r"\w+_\d+_\d+_[a-z_]+", query)
    record_ref = re.search(r"\w+_\d+_\d+(?!_)", query)
    chunk_ref, record_ref = chunk_ref and chunk_ref[0], record_ref and record_ref[0]
    said = query.lower()
    available = F.lit(False)
    for phrase, held in (("with pozhppurai", F.col("pozhppurai") != ""), ("with kurippurai", F.col("kurippurai") != ""), ("missing pozhppurai", F.col("pozhppurai") == ""), ("missing kurippurai", F.col("kurippurai") == "")):
        if phrase in said:
            available = available | held
    if "partial_commentary" in said:
        available = available | (F.col("extraction_status") == "partial_commentary")

    hits = {f: F.size(F.array_intersect(tokens, tx.search_tokens(F.col(f)))) for f in FIELD_WEIGHTS}
    named = available | (hits["search_text"] > 0)
    for key in ("song_no", "hymn_id", "author", "pann"):
        if filters.get(key):
            named = named | (F.col(key).cast("string") == str(filters[key]))
    if record_ref:
        named = named | (F.col("record_id") == record_ref)
    if chunk_ref:
        named = named | F.lit(chunk_ref).startswith(F.concat(F.col("record_id"), F.lit("_")))
    found = records.withColumn("named", named)
    candidates = found.where("named") if not found.where("named").isEmpty() else found
    candidates = candidates.where(passes_filters(filters))

    parts = [
        (F.lit(bool(chunk_ref)) & (F.col("chunk_id") == (chunk_ref or "")), F.lit(EXACT_CHUNK), "exact_chunk_id"),
        (F.lit(bool(record_ref)) & (F.col("record_id") == (record_ref or "")), F.lit(EXACT_RECORD), "exact_record_id"),
        (F.col("song_no") == str(filters["song_no"]) if filters.get("song_no") else F.lit(False), F.lit(EXACT_SONG), "exact_song_no"),
        (F.col("hymn_id") == str(filters["hymn_id"]) if filters.get("hymn_id") else F.lit(False), F.lit(EXACT_HYMN), "exact_hymn_id"),
        (F.contains("hymn_title", F.lit(query.strip())) if query.strip() else F.lit(False), F.lit(EXACT_TITLE), "exact_hymn_title"),
        (available, F.lit(AVAILABILITY), "commentary_availability"),
        *[(F.lit(True), F.lit(PER_FILTER), f"metadata_filter:{k}") for k in filters],
        *[(hits[f] > 0, hits[f] * w, f) for f, w in FIELD_WEIGHTS.items()],
        (F.arrays_overlap(tokens, F.col("unique_terms")), F.lit(CHUNK_TEXT), "chunk_text"),
    ]
    score, matched = F.lit(0), []
    for held, points, name in parts:
        score = score + F.when(held, points).otherwise(0)
        matched.append(F.when(held, name))
    rows = candidates.drop("rank_key").join(chunks, candidates["record_id"] == chunks["parent_record_id"])
    rows = rows.select(score.cast("bigint").alias("score"), "record_id", "chunk_id", F.array_sort(F.array_compact(F.array(*matched))).alias("matched_fields"), "rank_key")
    rows = rows.where("score > 0").orderBy(F.desc("score"), "rank_key", "chunk_id").limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "rank_key", "chunk_id")).cast("bigint"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(vector) -> Column:
    """vector of unit length; a zero vector is an error."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(F.raise_error(F.lit("embedding has zero norm")))


#: Query vectors of one pass, and rows of one matrix product.
PASS_VECTORS, PRODUCT_ROWS = 4096, 1024
#: Digits of a similarity that count, so that equal vectors tie whatever block they lie in.
SIMILARITY_DIGITS = 12


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length, scaled to length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    if not (length > 0).all():
        raise ValueError("embedding has zero norm")
    return rows / length


def semantic_search(queries: DataFrame, vectors: DataFrame, k: int = 10, filters: dict[str, object] | None = None) -> DataFrame:
    """query_id, rank, vec_id, similarity: exact cosine top-k of every query vector, ties by vec_id.

    queries (query_id, query_vector) are a stated set, held in passes of bounded size against all vectors that pass the filters:
    a matrix product for each block of vectors where it is read, of which a task hands on its k best of each query.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.where(passes_filters(filters or {})).where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    asked = queries.where("query_vector is not null").select("query_id", "query_vector")
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("similarity", T.DoubleType())])
    out, held = queries.sparkSession.createDataFrame([], schema), []

    def against(own: list) -> DataFrame:
        ids = np.array([r.query_id for r in own])
        block = _matrix(pa.array([r.query_vector for r in own]))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best_id = best = None
            for batch in batches:
                for at in range(0, len(batch), PRODUCT_ROWS):
                    part = batch.slice(at, PRODUCT_ROWS)
                    names = part.column(0).to_numpy(zero_copy_only=False)
                    near = np.round(block @ _matrix(part.column(1)).T, SIMILARITY_DIGITS)
                    names = np.broadcast_to(names, near.shape)
                    if best is not None:
                        near, names = np.concatenate([best, near], axis=1), np.concatenate([best_id, names], axis=1)
                    order = np.lexsort((names, -near), axis=1)[:, :k]
                    best, best_id = np.take_along_axis(near, order, 1), np.take_along_axis(names, order, 1)
            if best is not None:
                made = [np.repeat(ids, best.shape[1]), best_id.ravel(), best.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(m, to_arrow_type(f.dataType)) for m, f in zip(made, schema, strict=True)], schema.names)

        return rows.mapInArrow(find, schema)

    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == PASS_VECTORS:
            out, held = out.unionByName(against(held)), []
    return top_k(out.unionByName(against(held)) if held else out, k, "similarity", "vec_id")


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int = 10, lexical_weight: float = LEXICAL_WEIGHT, semantic_weight: float = SEMANTIC_WEIGHT, filters: int = 0) -> DataFrame:
    """query_id, rank, record_id, chunk_id, hybrid_score and its parts from ranked lexical and semantic results.

    lexical: query_id, rank, record_id, chunk_id, score, matched_fields. semantic: query_id, rank, record_id, chunk_id, similarity.
    Scores are divided by the best of the query. Of a record's several lexical results the last, lowest, gives the normalised
    score and the chunk; the raw score is the highest.
    """
    if lexical_weight < 0 or semantic_weight < 0 or lexical_weight + semantic_weight == 0:
        raise ValueError("hybrid weights must be non-negative, and one of them positive")
    of = Window.partitionBy("query_id")
    norm = lambda c: F.when(F.max(c).over(of) > 0, F.col(c) / F.max(c).over(of)).otherwise(0.0)
    lex = lexical.withColumn("norm", norm("score")).groupBy("query_id", "record_id").agg(
        F.max_by("norm", "rank").alias("lexical_norm"), F.max("score").cast("double").alias("lexical_score"), F.max_by("chunk_id", "rank").alias("lexical_chunk"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_fields")))).alias("matched_fields"),
    )
    sem = semantic.withColumn("norm", norm("similarity")).groupBy("query_id", "record_id").agg(
        F.max_by("norm", "rank").alias("semantic_norm"), F.max("similarity").alias("semantic_score"), F.min_by("chunk_id", "rank").alias("semantic_chunk")
    )
    rows = lex.join(sem, ["query_id", "record_id"], "full_outer")
    fields = F.coalesce("matched_fields", F.array().cast("array<string>"))
    exact = F.when(F.arrays_overlap(fields, F.array(*map(F.lit, EXACT_FIELDS))), 0.25).otherwise(0.0) + 0.05 * F.size(F.array_intersect(fields, F.array(*map(F.lit, TEXT_FIELDS))))
    meta_hits = F.size(F.filter(fields, lambda x: x.startswith("metadata_filter:")))
    meta = F.least(F.lit(0.20), 0.05 * F.when(meta_hits > 0, meta_hits).otherwise(filters)) if filters else F.lit(0.0)
    rows = rows.select(
        "query_id", "record_id", F.coalesce("lexical_chunk", "semantic_chunk").alias("chunk_id"),
        F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"),
        F.coalesce("lexical_norm", F.lit(0.0)).alias("lexical_norm"), F.coalesce("semantic_norm", F.lit(0.0)).alias("semantic_norm"),
        F.when(F.col("lexical_norm").isNotNull() & F.col("semantic_norm").isNotNull(), "both").when(F.col("lexical_norm").isNotNull(), "lexical").otherwise("semantic").alias("matched_modes"),
        exact.alias("exact_boost"), meta.alias("metadata_boost"),
    )
    rows = rows.withColumn("hybrid_score", lexical_weight * F.col("lexical_norm") + semantic_weight * F.col("semantic_norm") + F.col("exact_boost") + F.col("metadata_boost"))
    return top_k(rows, k, "hybrid_score", "record_id", "chunk_id")


def ablations(lexical: DataFrame, semantic: DataFrame, weights: list[tuple[float, float]], k: int = 10) -> DataFrame:
    """hybrid for each pair of weights, with the pair."""
    out = None
    for a, b in weights:
        own = hybrid(lexical, semantic, k, a, b).withColumns({"lexical_weight": F.lit(a), "semantic_weight": F.lit(b)})
        out = own if out is None else out.unionByName(own)
    return out


# --- query expansion: one query and small registries, on the driver --------------------------------------------


def term_pattern(term: str) -> re.Pattern:
    """A whole-word match that takes Tamil marks for word characters."""
    edge = r"[\w஀-௿]"
    return re.compile(rf"(?<!{edge}){re.escape(term)}(?!{edge})")


def find_term(query: str, candidates: list[str]) -> tuple[str, int] | None:
    """The candidate that is found first, the longest of those at one place, and where it ends."""
    found = [(m.start(), -len(c), c) for c in candidates if c and (m := term_pattern(c).search(query))]
    return (min(found)[2], min(found)[0] + len(min(found)[2])) if found else None


def expand(query: str, registries: list[tuple[str, list[dict]]]) -> dict:
    """The query with registered alternatives of its terms put after them.

    registries: (name, records with id, canonical, related), in the order in which they are asked.
    """
    plain = " ".join(query.split())
    terms, rules, insertions = {}, [], []
    for name, records in registries:
        for record in records:
            related = list(dict.fromkeys([record["canonical"], *record.get("related", [])]))
            if not (hit := find_term(plain, related)):
                continue
            approved = list(dict.fromkeys([hit[0], *related]))
            terms |= dict.fromkeys(approved)
            added = [t for t in approved if t != hit[0]]
            rules.append({"registry": name, "record_id": record["id"], "matched_term": hit[0], "added_terms": added})
            if added:
                insertions.append((hit[1], added))
    text = plain
    for at, added in sorted(insertions, key=lambda x: x[0], reverse=True):
        if fresh := [t for t in added if not term_pattern(t).search(text)]:
            text = f"{text[:at]} {' '.join(fresh)}{text[at:]}"
    text = " ".join(text.split())
    return {"expanded_terms": list(terms), "rules": rules, "text": text, "applied": text != plain, "registries": list(dict.fromkeys(r["registry"] for r in rules))}


#: Intents in order of priority with the words that show them, and what each groups by; fixed values
INTENTS = (
    ("group_by_author", "author", ("ஆசிரியர்", "ஆசிரியர்கள்", "நாயன்மார்", "author", "authors", "poet", "poets")),
    ("group_by_work", "work", ("work", "works", "நூல்", "நூல்கள்", "இலக்கியங்களில்", "பாடல்களில்")),
    ("group_by_category", "category", ("corpus", "category", "collection", "இலக்கியத்தில்", "இலக்கியம்", "தொகுப்பு")),
    ("group_by_record_type", "record_type", ("record type", "record types", "record_type", "வகை", "பகுதி")),
    ("compare_sources", "source", ("source", "sources", "மூலம்", "ஆதாரம்")),
)
#: Words that show a question about occurrences, that ask for variants, and that are no target; fixed values
ANALYTICAL_HINTS = ("அதிக", "அதிகம்", "எங்கு", "எந்த", "வருகிறது", "வருகின்றன", "mentions", "most", "count")
EXPANSION_HINTS = ("தொடர்பான", "சார்ந்த", "ஒத்த", "variant", "synonym")
TARGET_STOP = frozenset({"எந்த", "எங்கு", "அதிகம்", "அதிக", "வருகிறது", "வருகின்றன", "இல்", "உள்ள"})


def plain(text: str) -> str:
    """NFC on one line."""
    return " ".join(unicodedata.normalize("NFC", text or "").split())


def target_term(query: str, registered: list[str]) -> str:
    """The longest registered term in the query, else what is quoted, else its first Tamil word of two letters or more that is no stop word."""
    said = plain(query)
    if held := next((t for t in sorted(registered, key=lambda t: (-len(t), t)) if t and t in said), None):
        return held
    if quoted := re.search(r'"([^"]*)"', said):
        return quoted[1].strip()
    words = [w.strip(" ?.,:;\"'") for w in said.split() if any("\u0b80" <= c <= "\u0bff" for c in w)]
    return next((w for w in words if w not in TARGET_STOP and len(w) > 1), "")


def classify_query(query: str, registered: list[str] | None = None) -> dict:
    """intent, group_by, term and the words that decided: the first intent one of whose words the query has; unsupported without a target."""
    said = plain(query).lower()
    found = next(((name, by, [w for w in words if w.lower() in said]) for name, by, words in INTENTS if any(w.lower() in said for w in words)), None)
    if found is None and any(w.lower() in said for w in ANALYTICAL_HINTS):
        found = ("term_occurrence", None, [])
    term = target_term(query, registered or [])
    intent, group_by, words = found if found and term else ("unsupported", None, [])
    return {"query": plain(query), "intent": intent, "group_by": group_by, "term": term, "matched_group_keywords": words}
