"""Registered queries of the library, each over whole tables, with DuckDB SQL for what they return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.find import contained, find_exact
from corpusloom.operators import alignment, audit, entities, evaluation, linking, occurrences, rag, records, reports, retrieval, sampling, spans
from corpusloom.sources import html
from corpusloom.streaming.occurrence_stream import windowed_counts

QUERIES: dict = {}
ORACLES: dict = {}


def registered(sql: str | None):
    """Put a query and its SQL into the catalogue under the function's name."""

    def put(query):
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Terms that the occurrence queries look for, and an entity lexicon (term, type, canonical id); fixed values
TERMS = ("the", "that", "tion")
LEXICON = (
    ("the", "ARTICLE", "art_def"), ("les", "ARTICLE", "art_def"), ("der", "ARTICLE", "art_def"), ("los", "ARTICLE", "art_def"), ("un", "ARTICLE", "art_indef"), ("una", "ARTICLE", "art_indef"),
    ("of the", "PHRASE", "phr_of"), ("de la", "PHRASE", "phr_of"), ("and", "CONJUNCTION", "con_and"), ("und", "CONJUNCTION", "con_and"), ("et", "CONJUNCTION", "con_and"), ("with", "PREPOSITION", "pre_with"), ("mit", "PREPOSITION", "pre_with"),
)
_TERMS_SQL = ", ".join(f"('{t}')" for t in TERMS)
_LEXICON_SQL = ", ".join(f"('{t}', '{k}', '{c}')" for t, k, c in LEXICON)

#: DuckDB: overlapping occurrences of the terms in documents.
_OCC = f"""
firsts AS (SELECT doc_id, source, lang, text, term, string_split(text, left(term, 1)) AS p FROM documents, (VALUES {_TERMS_SQL}) v(term)),
pieces AS (SELECT doc_id, source, lang, text, term, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n FROM firsts),
placed AS (SELECT *, sum(length(piece) + 1) OVER (PARTITION BY doc_id, term ORDER BY i) - 1 AS s FROM pieces),
occ AS (
  SELECT doc_id, source, lang, text, term AS matched_term, CAST(s AS BIGINT) AS match_start, CAST(s + length(term) AS BIGINT) AS match_end
  FROM placed WHERE i < n AND substr(text, CAST(s + 1 AS BIGINT), length(term)) = term
)"""


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("record_id"), F.lit("text").alias("field_name"), "text", F.col("source").alias("author"), F.col("lang").alias("work"), "source", F.col("lang").alias("category_id"), F.lit("documents").alias("corpus_id"))


@registered(
    f"""WITH {_OCC}
SELECT source AS group_key, count(*) AS occurrence_count, count(DISTINCT doc_id) AS unique_records, count(DISTINCT lang) AS unique_works,
  count(*) FILTER (matched_term = 'the') AS n_the, count(*) FILTER (matched_term = 'that') AS n_that, count(*) FILTER (matched_term = 'tion') AS n_tion
FROM occ GROUP BY source ORDER BY occurrence_count DESC, group_key LIMIT 10"""
)
def occ_group_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occurrences.search(document_index(spark, sf_dir), list(TERMS))
    out = occurrences.group(found, "source", 10)
    counts = [F.coalesce(F.try_element_at("matched_term_counts", F.lit(t)), F.lit(0)).cast("bigint").alias(f"n_{t}") for t in TERMS]
    return out.select("group_key", "occurrence_count", "unique_records", "unique_works", *counts)


@registered(
    f"""WITH {_OCC}
SELECT doc_id AS record_id, matched_term, match_start, match_end,
  CASE WHEN match_start > 42 THEN '...' ELSE '' END || regexp_replace(substr(text, CAST(greatest(0, match_start - 42) + 1 AS BIGINT), CAST(least(length(text), match_end + 42) - greatest(0, match_start - 42) AS BIGINT)), '^\\s+|\\s+$', '', 'g')
    || CASE WHEN match_end + 42 < length(text) THEN '...' ELSE '' END AS snippet
FROM occ"""
)
def occ_positions_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occurrences.search(document_index(spark, sf_dir), list(TERMS))
    return found.select("record_id", "matched_term", F.col("match_start").cast("bigint").alias("match_start"), F.col("match_end").cast("bigint").alias("match_end"), "snippet")


@registered(f"WITH {_OCC} SELECT matched_term AS value, count(*) AS count FROM occ GROUP BY 1")
def occ_term_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.distribution(occurrences.search(document_index(spark, sf_dir), list(TERMS)), "matched_term").select("value", "count")


@registered(f"WITH {_OCC} SELECT count(*) AS total, count(DISTINCT doc_id) AS records, count(DISTINCT lang) AS works, count(DISTINCT source) AS authors FROM occ")
def occ_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.statistics(occurrences.search(document_index(spark, sf_dir), list(TERMS)))


@registered(
    """SELECT doc_id AS record_id, field_name, text FROM (
  SELECT doc_id, 'lang' AS field_name, lang AS text FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'text', text FROM documents
) WHERE text <> ''"""
)
def unpivot_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "record_id")
    return occurrences.index_rows(docs, ["record_id"], ["lang", "source", "text"]).select("record_id", "field_name", "text")


_LINES = r"list_filter(list_transform(string_split(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(160), ' '), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x0B\f]+', ' ', 'g'))), lambda x: x <> '')"


@registered(rf"SELECT doc_id, trim(regexp_replace(array_to_string({_LINES}, chr(10)), '\s+', ' ', 'g')) AS inline_text FROM documents")
def normalize_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_inline(F.col("text")).alias("inline_text"))


@registered(f"SELECT doc_id, array_to_string({_LINES}, chr(10)) AS normalized_text FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("normalized_text"))


@registered(
    r"""SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x0B\f]+', ' ', 'g'))), chr(10)), '^\n+|\n+$', '', 'g') AS multiline_text FROM documents"""
)
def normalize_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_multiline(F.col("text")).alias("multiline_text"))


_TOKENS = r"list_filter(list_transform(regexp_split_to_array(lower(%s), '[^\p{L}\p{N}_\x{0B80}-\x{0BFF}]+'), lambda x: trim(x, '_')), lambda x: x <> '')"


@registered(f"SELECT doc_id, len({_TOKENS % 'text'}) AS n_tokens, len(list_distinct({_TOKENS % 'text'})) AS n_unique, greatest(1, len({_TOKENS % 'text'})) AS token_estimate FROM documents")
def tokens_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.search_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_unique"), tx.token_estimate(F.col("t")).cast("bigint").alias("token_estimate"))


@registered(
    f"""SELECT doc_id, term, n, nth FROM (
  SELECT doc_id, term, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) AS nth
  FROM (SELECT doc_id, unnest({_TOKENS % 'text'}) AS term FROM documents) WHERE length(term) > 1 GROUP BY doc_id, term) WHERE nth <= 30"""
)
def keyword_candidates_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.keyword_candidates(table(spark, sf_dir, "documents"), "doc_id", tx.search_tokens(F.col("text")))


@registered(f"SELECT term, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id, unnest({_TOKENS % 'text'}) AS term FROM documents) GROUP BY term")
def postings_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = spans.postings(table(spark, sf_dir, "documents"), "doc_id", tx.search_tokens(F.col("text")))
    return posted.groupBy("term").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@registered(f"SELECT term, count(DISTINCT doc_id) AS n, CAST(sum(DISTINCT doc_id) AS BIGINT) AS id_sum, sha256(string_agg(DISTINCT CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR))) AS ids_sha256 FROM (SELECT doc_id, unnest({_TOKENS % 'text'}) AS term FROM documents) GROUP BY term")
def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term's ids, read back from their blocks and named by a digest; a term's blocks meet for the digest only."""
    lists = spans.posting_lists(spans.postings(table(spark, sf_dir, "documents"), "doc_id", tx.search_tokens(F.col("text"))), "doc_id")
    rows = lists.groupBy("term").agg(F.sum("n").alias("n"), F.sum(F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("id_sum"), F.flatten(F.collect_list("ids")).alias("ids"))
    return rows.select("term", "n", "id_sum", F.sha2(F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ","), 256).alias("ids_sha256"))


@registered(
    """WITH c AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', '', 'g') AS c, regexp_replace(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '\\s+', '', 'g') AS d FROM conversations),
g AS (SELECT conv_id, turn, list_distinct(CASE WHEN length(c) <= 3 THEN [c] ELSE list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3)) END) AS a,
  list_distinct(CASE WHEN length(d) <= 3 THEN [d] ELSE list_transform(range(1, length(d) - 1), lambda i: substr(d, i, 3)) END) AS b FROM c WHERE d IS NOT NULL)
SELECT conv_id, turn, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity FROM g"""
)
def char_trigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = turns.withColumn("next_text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next_text is not null")
    rows = rows.select("conv_id", "turn", tx.char_ngrams(F.col("text")).alias("a"), tx.char_ngrams(F.col("next_text")).alias("b"))
    return rows.select("conv_id", "turn", tx.jaccard(F.col("a"), F.col("b")).alias("similarity"))


#: A line with its break, and the break.
_BREAK = r"(?:\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}])$"
_LINE = r"[^\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}])|[^\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]+"


@registered(
    rf"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_LINE}')) AS raw, generate_subscripts(regexp_extract_all(text, '{_LINE}'), 1) AS i FROM documents),
p AS (SELECT *, regexp_replace(raw, '{_BREAK}', '') AS line_text, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i) - length(raw) AS b FROM l)
SELECT doc_id, CAST(i AS BIGINT) AS line_no, CAST(b AS BIGINT) AS start_char, CAST(b + length(line_text) AS BIGINT) AS end_char, line_text FROM p WHERE regexp_matches(line_text, '[^\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]')"""
)
def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.line_spans(table(spark, sf_dir, "documents"), "doc_id")


_SEGMENTS = r"""l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?।;,]*[.!?।;,]+|[^.!?।;,]+')) AS raw, generate_subscripts(regexp_extract_all(text, '[^.!?।;,]*[.!?।;,]+|[^.!?।;,]+'), 1) AS i FROM documents),
p AS (SELECT *, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i) - length(raw) AS b, regexp_replace(raw, '^\s+', '') AS r, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM l),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS segment_no, CAST(b + length(raw) - length(r) AS BIGINT) AS start_char, CAST(b + length(raw) - length(r) + length(t) AS BIGINT) AS end_char, t AS segment_text FROM p WHERE t <> '')"""


@registered(f"WITH {_SEGMENTS} SELECT * FROM s")
def segment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.segment_spans(table(spark, sf_dir, "documents"), "doc_id")


@registered(
    f"""WITH {_SEGMENTS}, w AS (
  SELECT doc_id, segment_no, start_char, k + 1 AS window_size, CASE k WHEN 0 THEN segment_no WHEN 1 THEN lead(segment_no, 1) OVER o ELSE lead(segment_no, 2) OVER o END AS segment_end_no,
    CASE k WHEN 0 THEN end_char WHEN 1 THEN lead(end_char, 1) OVER o ELSE lead(end_char, 2) OVER o END AS end_char
  FROM s, (VALUES (0), (1), (2)) v(k) WINDOW o AS (PARTITION BY doc_id, k ORDER BY segment_no))
SELECT doc_id, segment_no, start_char, CAST(window_size AS BIGINT) AS window_size, segment_end_no, end_char FROM w WHERE segment_end_no IS NOT NULL"""
)
def segment_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.segment_windows(spans.segment_spans(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of each user turn with the reply as its commentary: verse, pozhppurai (reply), kurippurai (none), metadata."""
    turns = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumns({"reply": F.lead("text").over(w), "reply_role": F.lead("role").over(w)}).where("role = 'user'")
    reply = F.when(F.col("reply_role") == "assistant", F.col("reply")).otherwise("")
    return rows.select(F.concat_ws("_", F.lit("conv"), "conv_id", "turn").alias("record_id"), "conv_id", "turn", tx.normalize_inline(F.col("text"), False).alias("verse"), tx.normalize_inline(reply, False).alias("pozhppurai"), F.lit("").alias("kurippurai"), F.concat(F.lit("conversation "), "conv_id").alias("metadata"))


_RECORDS = r"""r AS (
  SELECT 'conv_' || conv_id || '_' || turn AS record_id, conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS verse, CASE WHEN rr = 'assistant' THEN trim(regexp_replace(reply, '\s+', ' ', 'g')) ELSE '' END AS pozhppurai, 'conversation ' || conv_id AS metadata
  FROM (SELECT *, lead(text) OVER o AS reply, lead(role) OVER o AS rr FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"""


@registered(
    f"""WITH {_RECORDS}, c AS (
  SELECT record_id, 'verse_only' AS chunk_type, verse AS t FROM r UNION ALL SELECT record_id, 'metadata_context', metadata FROM r
  UNION ALL SELECT record_id, 'verse_plus_commentary', verse || CASE WHEN verse <> '' AND pozhppurai <> '' THEN chr(10) ELSE '' END || pozhppurai FROM r
  UNION ALL SELECT record_id, 'pozhppurai_only', pozhppurai FROM r WHERE pozhppurai <> '')
SELECT record_id || '_' || chunk_type AS chunk_id, record_id AS parent_record_id, chunk_type, length(t) AS char_count, greatest(1, len({_TOKENS % 't'})) AS token_estimate FROM c"""
)
def chunks_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.chunks(conversation_records(spark, sf_dir)).select("chunk_id", "parent_record_id", "chunk_type", "char_count", "token_estimate")


_LEXICAL = f"""q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS % 'text'})) AS term FROM benchmark),
d AS (SELECT doc_id AS record_id, unnest(list_distinct({_TOKENS % 'text'})) AS term FROM documents),
m AS (SELECT query_id, record_id, 400 * count(*) AS score FROM q JOIN d USING (term) GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM m) WHERE rank <= 10)"""


def _lexical(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("search_text"))
    return retrieval.lexical_topk(queries, records, k, {"search_text": retrieval.FIELD_WEIGHTS["search_text"]})


@registered(f"WITH {_LEXICAL} SELECT query_id, rank, record_id, score FROM lexical")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).select("query_id", "rank", "record_id", "score")


def _semantic(spark: SparkSession, sf_dir: str, filters: dict | None = None) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.semantic_search(queries, vectors, 10, filters)


_SEMANTIC = """SELECT query_id, rank, vec_id FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY
    round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 12) DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0{}) WHERE rank <= 10"""


@registered(_SEMANTIC.format(""))
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir).select("query_id", "rank", "vec_id")


@registered(_SEMANTIC.format(" AND v.label = 3"))
def semantic_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir, {"label": 3}).select("query_id", "rank", "vec_id")


@registered(
    f"""WITH {_LEXICAL},
sem AS (SELECT * FROM (SELECT q.item_id AS query_id, v.vec_id AS record_id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) * list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 12) AS similarity
  FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id, embeddings v) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, record_id) <= 10),
l AS (SELECT query_id, record_id, score / max(score) OVER (PARTITION BY query_id) AS ln FROM lexical),
s AS (SELECT query_id, record_id, CASE WHEN max(similarity) OVER (PARTITION BY query_id) > 0 THEN similarity / max(similarity) OVER (PARTITION BY query_id) ELSE 0 END AS sn FROM sem),
h AS (SELECT query_id, record_id, 0.65 * coalesce(ln, 0) + 0.35 * coalesce(sn, 0) + CASE WHEN ln IS NOT NULL THEN 0.05 ELSE 0 END AS score, CASE WHEN ln IS NULL THEN 'semantic' WHEN sn IS NULL THEN 'lexical' ELSE 'both' END AS matched_modes FROM l FULL JOIN s USING (query_id, record_id))
SELECT query_id, rank, record_id, matched_modes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM h) WHERE rank <= 10"""
)
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = _lexical(spark, sf_dir).withColumns({"chunk_id": F.col("record_id").cast("string"), "matched_fields": F.array(F.lit("search_text"))})
    vectors = table(spark, sf_dir, "embeddings")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id")
    semantic = retrieval.semantic_search(queries, vectors, 10).select("query_id", "rank", F.col("vec_id").alias("record_id"), F.col("vec_id").cast("string").alias("chunk_id"), "similarity")
    return retrieval.hybrid(lexical, semantic, 10).select("query_id", "rank", "record_id", "matched_modes")


#: A registry of related terms for query expansion; fixed values
REGISTRIES = [("synonyms", [{"id": "syn_def", "canonical": "the", "related": ["les", "der"]}]), ("themes", [{"id": "thm_shape", "canonical": "forma", "related": ["tion"]}])]


@registered("""SELECT term, count(*) AS documents FROM documents, (VALUES ('the'), ('les'), ('der')) v(term) WHERE contains(text, term) GROUP BY term""")
def query_expand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = retrieval.expand("the", REGISTRIES)["expanded_terms"]
    found = occurrences.search(document_index(spark, sf_dir), terms)
    return found.groupBy(F.col("matched_term").alias("term")).agg(F.count_distinct("record_id").alias("documents"))


_FKS = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"))


@registered(" UNION ALL ".join(f"SELECT '{a}.{k}' AS \"check\", count(*) AS bad_rows, count(DISTINCT {k}) AS bad_keys FROM {a} WHERE {k} NOT IN (SELECT {p} FROM {b})" for a, k, b, p in _FKS))
def fk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [audit.foreign_keys(table(spark, sf_dir, a), k, table(spark, sf_dir, b), p, f"{a}.{k}") for a, k, b, p in _FKS]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@registered("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@registered("SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) <> 1")
def one_to_one_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.one_to_one(table(spark, sf_dir, "orders"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey")


@registered("SELECT conv_id, count(*) AS n, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS distinct_numbers, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id")
def contiguous_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.contiguity(table(spark, sf_dir, "conversations"), "conv_id", "turn", 0)


@registered("SELECT l_orderkey, l_linenumber, p AS previous FROM (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS p FROM lineitem) WHERE p > l_partkey")
def non_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.out_of_order(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_suppkey", "l_partkey"], "l_partkey").select("l_orderkey", "l_linenumber", "previous")


@registered(
    "WITH d AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)) "
    + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (trim(CAST({c} AS VARCHAR)) <> '') AS present, count(*) - count(*) FILTER (trim(CAST({c} AS VARCHAR)) <> '') AS missing, count(*) FILTER (trim(CAST({c} AS VARCHAR)) <> '') * 100 / count(*) AS percentage FROM d" for c in ("text", "lang", "source", "quality", "toxic"))
)
def coverage_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return audit.coverage(rows, ["text", "lang", "source", "quality", "toxic"])


@registered(rf"SELECT 'text' AS field, count(*) FILTER (text <> array_to_string({_LINES}, chr(10))) AS changed FROM documents UNION ALL SELECT 'source', 0")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return audit.changed_fields(docs, docs.withColumn("text", tx.normalize_text(F.col("text"))), "doc_id", ["text", "source"])


@registered("SELECT lang, p, v[CAST(round_even((len(v) - 1) * p, 0) AS BIGINT) + 1] AS value FROM (SELECT lang, list_sort(list(n_chars)) AS v FROM documents GROUP BY lang), (VALUES (CAST(0.05 AS DOUBLE)), (0.25), (0.5), (0.75), (0.95)) s(p)")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.nearest_rank(table(spark, sf_dir, "documents"), "n_chars", [0.05, 0.25, 0.5, 0.75, 0.95], "lang")


_EDGE = r"[^\p{L}\p{N}_\x{0B80}-\x{0BFF}]"
#: DuckDB has no look-around: all places of the term whose neighbours aren't word characters. Whole-word matches of a term can't overlap.
_MENTIONS = f"""
firsts AS (SELECT doc_id, text, term, entity_type, canonical_id, string_split(text, term) AS p FROM documents, (VALUES {_LEXICON_SQL}) v(term, entity_type, canonical_id)),
pieces AS (SELECT * EXCLUDE p, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n FROM firsts),
placed AS (SELECT *, sum(length(piece) + length(term)) OVER (PARTITION BY doc_id, term ORDER BY i) - length(term) AS s FROM pieces),
mentions AS (
  SELECT doc_id, term, entity_type, canonical_id, CAST(s AS BIGINT) AS start_char, CAST(s + length(term) AS BIGINT) AS end_char FROM placed
  WHERE i < n AND (s = 0 OR regexp_matches(substr(text, CAST(s AS BIGINT), 1), '{_EDGE}')) AND (s + length(term) = length(text) OR regexp_matches(substr(text, CAST(s + length(term) + 1 AS BIGINT), 1), '{_EDGE}'))
)"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities.mentions(table(spark, sf_dir, "documents"), "doc_id", list(LEXICON))
    return found.withColumns({"start_char": F.col("start_char").cast("bigint"), "end_char": F.col("end_char").cast("bigint")})


@registered(f"WITH {_MENTIONS} SELECT * FROM mentions")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir)


_KEPT = f"""{_MENTIONS}, kept AS (SELECT * FROM mentions m WHERE NOT EXISTS (SELECT 1 FROM mentions b WHERE b.doc_id = m.doc_id AND b.start_char <= m.start_char AND b.end_char >= m.end_char AND b.end_char - b.start_char > m.end_char - m.start_char))"""


@registered(f"WITH {_KEPT} SELECT * FROM kept")
def suppress_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.suppress_contained(_mentions(spark, sf_dir), ["doc_id"])


@registered(
    f"""WITH {_MENTIONS}, cells AS (SELECT DISTINCT doc_id, term, entity_type, start_char, end_char, unnest(range(start_char // 16, (end_char - 1) // 16 + 1)) AS cell FROM mentions)
SELECT DISTINCT a.doc_id, a.term AS term_a, a.start_char AS start_char_a, b.term AS term_b, b.start_char AS start_char_b FROM cells a JOIN cells b ON a.doc_id = b.doc_id AND a.cell = b.cell AND a.start_char < b.end_char AND b.start_char < a.end_char AND a.entity_type < b.entity_type"""
)
def interval_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.overlap_pairs(_mentions(spark, sf_dir), "doc_id").select("doc_id", "term_a", "start_char_a", "term_b", "start_char_b")


@registered(f"WITH {_MENTIONS} SELECT a.doc_id, a.term, a.start_char, count(*) AS children FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.start_char <= b.start_char AND b.end_char <= a.end_char AND a.end_char - a.start_char > b.end_char - b.start_char GROUP BY ALL")
def parent_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.covering_parents(_mentions(spark, sf_dir), "doc_id", 1)


@registered(f"WITH {_MENTIONS}, e AS (SELECT DISTINCT doc_id, canonical_id FROM mentions) SELECT a.canonical_id AS source, b.canonical_id AS target, count(*) AS evidence_count, min(a.doc_id) AS example FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.canonical_id < b.canonical_id GROUP BY ALL HAVING count(*) >= 3")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.cooccurrence(_mentions(spark, sf_dir), "doc_id").select("source", "target", "evidence_count", "example")


@registered("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) = 1")
def best_per_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return sampling.best_per_key(rows, ["l_partkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_suppkey"])


@registered(
    "SELECT conv_id, turn, n, coalesce(p, -1) AS previous_target, coalesce(x, -1) AS next_target, (p IS NULL OR p <= n) AND (x IS NULL OR n <= x) AS coherent FROM (SELECT conv_id, turn, length(text) AS n, lag(length(text)) OVER o AS p, lead(length(text)) OVER o AS x FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))"
)
def neighbor_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    rows = alignment.neighbours(turns, "conv_id", "turn", "n")
    return rows.withColumns({c: F.coalesce(c, F.lit(-1).cast("bigint")) for c in ("previous_target", "next_target")})


@registered(
    "SELECT conv_id, count(*) AS n, CASE WHEN count(*) < 3 OR count(*) FILTER (x >= n) >= count(*) FILTER (x < n) THEN 'forward' ELSE 'reverse' END AS direction FROM (SELECT conv_id, length(text) AS n, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM conversations) GROUP BY conv_id"
)
def group_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("len"))
    return alignment.direction(turns, "conv_id", "turn", "len")


@registered("SELECT conv_id, turn, text, x AS negative_target FROM (SELECT *, lead(role || ':' || length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS x, role || ':' || length(text) AS y FROM conversations) WHERE x IS NOT NULL AND x <> y")
def adjacent_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("target", F.concat_ws(":", "role", F.length("text")))
    return alignment.hard_negatives(turns, "conv_id", "turn", "text", "target")


@registered("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) <= 5")
def hash_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 5, ["source"])


@registered("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang FROM r WHERE n <= 7 OR list_contains(list_transform(range(7), lambda k: CAST(round_even(k * (n - 1) / 6, 0) AS BIGINT)), i)")
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.spread_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 7, ["lang"])


@registered(
    """WITH r AS (SELECT doc_id, CASE WHEN n_chars > 5000 THEN 1 WHEN lang <> 'en' THEN 2 WHEN n_chars < 300 THEN 3 END AS k, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h, doc_id) AS nth FROM r WHERE k IS NOT NULL)
SELECT doc_id, ['long', 'other_language', 'short'][k] AS sample_reason FROM q WHERE nth <= [10, 20, 15][k] ORDER BY k, h, doc_id LIMIT 40"""
)
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = [("long", F.col("n_chars") > 5000, 10), ("other_language", F.col("lang") != "en", 20), ("short", F.col("n_chars") < 300, 15)]
    return sampling.quota_sample(table(spark, sf_dir, "documents"), "doc_id", quotas, 40).select("doc_id", "sample_reason")


@registered(
    """WITH t AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), m AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM t),
c AS (SELECT sum(x.n * y.n) AS chance FROM (SELECT a, sum(n) AS n FROM t GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM t GROUP BY b) y ON a = b)
SELECT CAST(n AS BIGINT) AS n, CAST(same / n AS DOUBLE) AS observed, CAST(chance / (n * n) AS DOUBLE) AS expected FROM m, c"""
)
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cohen_kappa(table(spark, sf_dir, "labels"), "quality", "toxic").select("n", "observed", "expected")


@registered(f"WITH {_MENTIONS}, g AS (SELECT DISTINCT doc_id, start_char, end_char FROM mentions WHERE entity_type = 'ARTICLE'), p AS (SELECT DISTINCT doc_id, start_char, end_char FROM mentions WHERE canonical_id IN ('art_def', 'phr_of')), b AS (SELECT g.doc_id AS g, p.doc_id AS p FROM g FULL JOIN p USING (doc_id, start_char, end_char)) SELECT count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS true_positive, count(*) FILTER (g IS NULL) AS false_positive, count(*) FILTER (p IS NULL) AS false_negative FROM b")
def precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mentions(spark, sf_dir)
    out = entities.evaluate(found.where("entity_type = 'ARTICLE'"), found.where("canonical_id in ('art_def', 'phr_of')"), ["doc_id", "start_char", "end_char"])
    return out.select("true_positive", "false_positive", "false_negative")


#: Expected: documents that hold an item's whole text.
_EXPECTED = "expected AS (SELECT item_id AS query_id, doc_id AS record_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '')"
#: Most characters of phrases that one pass over the documents looks for.
PASS_CHARS = 4 << 20


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, record_id of documents that hold an item's whole text; items are a stated set, taken in passes of bounded size."""
    docs, out, held, size = table(spark, sf_dir, "documents"), None, [], 0
    for row in [*table(spark, sf_dir, "benchmark").select("item_id", "text").toLocalIterator(), None]:
        if row and row.text:
            held.append((row.item_id, row.text))
            size += len(row.text)
        if held and size >= PASS_CHARS or row is None:
            own = contained(docs, "doc_id", held).select(F.col("phrase_id").alias("query_id"), F.col("doc_id").alias("record_id"))
            out, held, size = own if out is None else out.unionByName(own), [], 0
    return out.distinct()


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return evaluation.per_query(queries, _lexical(spark, sf_dir), _expected(spark, sf_dir))


@registered(
    f"""WITH {_LEXICAL}, {_EXPECTED}, f AS (SELECT query_id, min(rank) AS first FROM lexical SEMI JOIN expected USING (query_id, record_id) GROUP BY query_id)
SELECT count(*) AS queries, count(*) FILTER (first <= 1) AS hits_1, count(*) FILTER (first <= 10) AS hits_10 FROM benchmark LEFT JOIN f ON item_id = query_id"""
)
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).agg(F.count("*").alias("queries"), F.count_if("hit_at_1").alias("hits_1"), F.count_if("hit_at_10").alias("hits_10"))


@registered(
    f"""WITH {_LEXICAL}, {_EXPECTED}, f AS (SELECT query_id, min(rank) AS first FROM lexical SEMI JOIN expected USING (query_id, record_id) GROUP BY query_id), n AS (SELECT query_id, count(*) AS n FROM lexical GROUP BY query_id), x AS (SELECT query_id, count(*) AS n FROM expected GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN first <= 10 THEN 'passed' WHEN coalesce(x.n, 0) = 0 THEN 'vocabulary_gap' WHEN coalesce(n.n, 0) = 0 THEN 'no_candidates' WHEN first IS NULL THEN 'not_retrieved' ELSE 'ranked_low' END AS failure
FROM benchmark LEFT JOIN f ON item_id = f.query_id LEFT JOIN n ON item_id = n.query_id LEFT JOIN x ON item_id = x.query_id"""
)
def failure_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evaluated(spark, sf_dir)
    first = F.when(F.col("reciprocal_rank") > 0, 1 / F.col("reciprocal_rank"))
    results = _lexical(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("results"))
    return rows.join(results, "query_id", "left").select("query_id", evaluation.failure(first, F.col("results"), F.col("relevant") + F.col("missing")).alias("failure"))


@registered(f"SELECT CAST(quality AS VARCHAR) AS relation, term AS feature, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest({_TOKENS % 'text'}) AS term FROM documents) JOIN labels USING (doc_id) GROUP BY ALL")
def pattern_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("relation", F.col("quality").cast("string"))
    return evaluation.learn_patterns(rows, "relation", tx.search_tokens(F.col("text")))


@registered(
    """SELECT doc_id, s AS score_millis, CASE WHEN s >= 780 THEN 'high' WHEN s >= 500 THEN 'medium' WHEN s >= 250 THEN 'low' ELSE 'none' END AS tier FROM (
  SELECT doc_id, CAST(round_even(1000 * greatest(0, least(1, CAST(0.45 AS DOUBLE) * ((doc_id % 101) / 100) + CAST(1.9 AS DOUBLE) * ((doc_id % 37) / 100) + CAST(0.04 AS DOUBLE) - CAST(0.1 AS DOUBLE) * (doc_id % 5))), 0) AS BIGINT) AS s FROM documents)"""
)
def linear_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = evaluation.calibrated((F.col("doc_id") % 101) / 100, (F.col("doc_id") % 37) / 100, F.lit(0.1) * (F.col("doc_id") % 5))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.bround(1000 * score, 0).cast("bigint").alias("score_millis"))
    return rows.select("doc_id", "score_millis", evaluation.tier(F.col("score_millis") / 1000).alias("tier"))


@registered(
    f"""WITH {_LEXICAL}, r AS (SELECT query_id, rank, record_id, text, lang, sum(length(text) + length(lang)) OVER o - length(text) - length(lang) AS b, row_number() OVER o AS i FROM lexical JOIN documents ON record_id = doc_id WINDOW o AS (PARTITION BY query_id ORDER BY rank, record_id))
SELECT query_id, 'ctx_' || lpad(CAST(i AS VARCHAR), 3, '0') AS context_id, rank, record_id, CAST(least(length(text) + length(lang), 6000 - b) AS BIGINT) AS content_char_count, 6000 - b < length(text) + length(lang) AS content_truncated FROM r WHERE i <= 5 AND b < 6000"""
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _lexical(spark, sf_dir).withColumn("chunk_id", F.col("record_id").cast("string"))
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text", "lang")
    return rag.context_package(results, records, ["text", "lang"]).select("query_id", "context_id", "rank", "record_id", "content_char_count", "content_truncated")


@registered(
    f"""WITH {_LEXICAL}, c AS (SELECT query_id, lang, 'cit_' || lpad(CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, record_id) AS VARCHAR), 3, '0') AS id FROM lexical JOIN documents ON record_id = doc_id)
SELECT query_id, lang, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n FROM c GROUP BY ALL"""
)
def citation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "lang")
    cited = rag.citations(_lexical(spark, sf_dir).join(docs, "record_id"), ["lang"])
    return rag.citation_groups(cited, ["lang"]).select("query_id", "lang", F.array_join("citation_ids", ",").alias("ids"), "n")


@registered(
    r"""SELECT page_id, CAST(generate_subscripts(m, 1) - 1 AS BIGINT) AS link_no, regexp_extract(unnest(m), 'href="([^"]*)"', 1, 's') AS href FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>') AS m FROM pages)"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(table(spark, sf_dir, "pages")).select("page_id", F.col("link_no").cast("bigint").alias("link_no"), "href")


@registered(
    r"""SELECT page_id, CASE WHEN contains(regexp_extract(url, '\?([^#]*)', 1), 'page=') THEN 'listing' WHEN regexp_matches(p, '^/?$') THEN 'home' WHEN ends_with(p, '.html') THEN 'document' WHEN ends_with(p, '/') THEN 'directory' WHEN regexp_matches(p, '/[0-9]+$') THEN 'record' ELSE 'other' END AS page_type
FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS p FROM pages)"""
)
def page_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.page_type(F.col("url")).alias("page_type"))


@registered(
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages"""
)
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@registered(r"SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page_no, regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS utm_source FROM pages")
def url_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = table(spark, sf_dir, "pages").select("page_id", tx.query_map(F.col("url")).alias("q"))
    return params.select("page_id", F.coalesce(F.try_element_at("q", F.lit("page")), F.lit("")).alias("page_no"), F.coalesce(F.try_element_at("q", F.lit("utm_source")), F.lit("")).alias("utm_source"))


@registered(None)
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.elements(table(spark, sf_dir, "pages"))


@registered(
    r"""WITH t AS (SELECT doc_id, n, regexp_extract_all(n, '[\x{0B80}-\x{0BFF}0-9A-Za-z]+') AS k, length(n) - length(regexp_replace(n, '[A-Za-z]', '', 'g')) AS letters
  FROM (SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[\s\x0B\x{85}\x{A0}\x{2028}\x{2029}]+', ' ', 'g')) AS n FROM documents))
SELECT doc_id, len(k) AS token_count, letters AS script_chars, CASE WHEN w IS NULL THEN 'keep' ELSE 'reject' END AS status, coalesce(w, CASE WHEN len(k) = 1 THEN 'short_but_valid_single_token' WHEN len(k) <= 2 THEN 'very_short_span' ELSE 'clean' END) AS flag
FROM (SELECT *, CASE WHEN n = '' THEN 'empty' WHEN regexp_full_match(n, '[\s,.;:!?()\[\]{}"\x27“”‘’\-–—/\\|]+') THEN 'punctuation_only' WHEN len(k) > 0 AND len(list_filter(k, lambda x: NOT regexp_full_match(x, '[0-9]+'))) = 0 THEN 'numeric_only'
  WHEN letters = 0 THEN 'no_tamil_text' WHEN letters < 2 THEN 'too_few_tamil_chars' END AS w FROM t)"""
)
def text_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules with Latin letters for the corpus's script."""
    latin = lambda text: F.regexp_count(text, F.lit("[A-Za-z]"))
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.text_quality(F.col("text"), script=latin).alias("q"))
    return rows.select("doc_id", "q.token_count", "q.script_chars", "q.status", F.col("q.flags")[0].alias("flag"))


@registered("SELECT doc_id, (contains(text, 'the') OR contains(text, 'les')) AND (contains(text, 'and') OR contains(text, 'et')) AS held FROM documents")
def cue_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.cue_present(F.col("text"), "the|les + and|et").alias("held"))


@registered("SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR) || '|' || source || '|' || lang), 1, 16) AS stable_hash, lower(source) || '_' || lower(lang) AS stable_id, lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(n_chars AS VARCHAR), CAST(greatest(4, length(CAST(n_chars AS VARCHAR))) AS INTEGER), '0') AS rank_key FROM documents")
def record_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.stable_hash(F.col("doc_id"), F.col("source"), F.col("lang")).alias("stable_hash"), tx.stable_id(F.col("source"), F.col("lang")).alias("stable_id"), tx.rank_key(F.col("doc_id"), F.col("n_chars")).alias("rank_key"))


@registered(None)
def align_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of user turns aligned with clauses of the replies, by conversation turn."""
    records = conversation_records(spark, sf_dir).where("pozhppurai <> ''").withColumn("group", F.col("conv_id") * 100_000 + F.col("turn"))
    lines = spans.segment_spans(records, "group", "verse").select("group", F.col("segment_no").alias("line_no"), tx.char_ngrams(F.col("segment_text")).alias("a"))
    clauses = spans.segment_spans(records, "group", "pozhppurai").select("group", F.col("segment_no").alias("first"), tx.char_ngrams(F.col("segment_text")).alias("b"))
    pairs = lines.join(clauses, "group")
    return alignment.align(pairs.select("group", "line_no", "first", F.col("first").alias("last"), tx.jaccard(F.col("a"), F.col("b")).alias("score")))


@registered("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"])


#: Types and relations of a small ontology; fixed values
ONTOLOGY_TYPES = ("ARTICLE", "PHRASE", "CONJUNCTION", "PHRASE")
ONTOLOGY_RELATIONS = (("joins", ["CONJUNCTION"], ["PHRASE", "CLAUSE"]), ("marks", ["ARTICLE"], ["NOUN"]))


@registered("SELECT * FROM (VALUES ('duplicate_type', 'PHRASE'), ('unknown_range', 'joins:CLAUSE'), ('unknown_range', 'marks:NOUN')) v(code, name)")
def ontology_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame([(t,) for t in ONTOLOGY_TYPES], "name string")
    return entities.ontology_violations(types, spark.createDataFrame(list(ONTOLOGY_RELATIONS), "name string, domain array<string>, range array<string>"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = conversation_records(spark, sf_dir).where("pozhppurai <> ''").select("record_id", "verse", "pozhppurai")
    return linking.candidate_features(records, "record_id", "verse", "pozhppurai")


_GRAMS3 = "list_distinct(CASE WHEN length({0}) <= 3 THEN [{0}] ELSE list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)) END)"
_JACCARD = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"


@registered(
    rf"""WITH {_RECORDS}, {_SEGMENTS.replace("documents", "r WHERE pozhppurai <> ''").replace("doc_id", "record_id").replace("text,", "pozhppurai,")},
w AS (SELECT record_id, segment_no, start_char, k + 1 AS window_size, CASE k WHEN 0 THEN segment_no WHEN 1 THEN lead(segment_no, 1) OVER o ELSE lead(segment_no, 2) OVER o END AS segment_end_no,
  CASE k WHEN 0 THEN end_char WHEN 1 THEN lead(end_char, 1) OVER o ELSE lead(end_char, 2) OVER o END AS end_char FROM s, (VALUES (0), (1), (2)) v(k) WINDOW o AS (PARTITION BY record_id, k ORDER BY segment_no)),
x AS (SELECT w.*, verse, substr(pozhppurai, start_char + 1, end_char - start_char) AS target, list_distinct({_TOKENS % "verse"}) AS a, regexp_replace(verse, '\s+', '', 'g') AS vc FROM w JOIN r USING (record_id) WHERE segment_end_no IS NOT NULL AND verse <> ''),
y AS (SELECT *, list_distinct({_TOKENS % "target"}) AS b, regexp_replace(target, '\s+', '', 'g') AS tc FROM x), z AS (SELECT *, {_GRAMS3.format("vc")} AS c, {_GRAMS3.format("tc")} AS d FROM y),
f AS (SELECT *, {_JACCARD.format("a", "b")} AS token_score, {_JACCARD.format("c", "d")} AS char_score, CASE WHEN contains(tc, vc) THEN 1.0 WHEN len(a) = 0 THEN 0 ELSE len(list_filter(a, lambda t: contains(target, t))) / len(a) END AS containment FROM z),
g AS (SELECT *, round_even(CAST(0.22 AS DOUBLE) * token_score + CAST(0.15 AS DOUBLE) * char_score + CAST(0.15 AS DOUBLE) * containment + CAST(0.12 AS DOUBLE), 4) AS score FROM f),
h AS (SELECT *, row_number() OVER q AS nth, lead(score) OVER q AS second, count(*) OVER (PARTITION BY record_id) AS candidate_count FROM g WINDOW q AS (PARTITION BY record_id ORDER BY score DESC, window_size, segment_no)),
m AS (SELECT *, CAST(round_even(score - coalesce(second, 0), 4) AS DOUBLE) AS score_margin, token_score >= 0.18 OR containment >= 0.45 AS strong FROM h WHERE nth = 1),
n AS (SELECT *, CASE WHEN score >= 0.52 AND strong THEN 'high' WHEN score >= 0.32 OR (score >= 0.27 AND strong) THEN 'medium' ELSE 'low' END AS confidence FROM m)
SELECT record_id, 1 AS line_no, segment_no, segment_end_no, CAST(score AS DOUBLE) AS score, score_margin, candidate_count, confidence, CASE confidence WHEN 'high' THEN 'strong_link' WHEN 'medium' THEN 'usable_review' ELSE
  CASE WHEN greatest(token_score, char_score, containment) = 0 THEN 'order_only_weak_match' WHEN score_margin < 0.03 THEN 'ambiguous_multiple_targets' WHEN token_score = 0 AND containment < 0.15 THEN 'low_lexical_overlap' ELSE 'no_shared_entity_anchor' END END AS diagnostic FROM n"""
)
def link_best_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linking.best_links(_links(spark, sf_dir), "record_id", "line_no")
    return out.select("record_id", "line_no", "segment_no", "segment_end_no", "score", "score_margin", "candidate_count", "confidence", "diagnostic")


_PROMOTED = """SELECT doc_id, n_chars % 3 AS c, CASE WHEN w = 'medium' AND p >= 0.42 AND n >= 2 THEN 'high' WHEN w = 'low' AND p >= 0.6 AND n >= 1 THEN 'high' WHEN w = 'low' AND p >= 0.38 AND n >= 2 THEN 'medium' ELSE w END AS confidence
FROM (SELECT doc_id, n_chars, ['high', 'medium', 'low'][doc_id % 3 + 1] AS w, (doc_id % 97) / 100 AS p, doc_id % 4 AS n FROM documents)"""


@registered(_PROMOTED)
def link_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = F.array(F.lit("rule"), F.lit("anchor"), F.lit("cue"))
    rows = docs.select(
        "doc_id", (F.col("n_chars") % 3).alias("c"), F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("doc_id") % 3 + 1).cast("int")).alias("confidence"),
        ((F.col("doc_id") % 97) / 100).alias("learned_pattern_score"), F.slice(names, 1, (F.col("doc_id") % 4).cast("int")).alias("evidence"), F.lit(0.3).alias("score"), F.lit(False).alias("manual_review_required"),
    )
    return linking.promoted(rows, F.lit(False)).select("doc_id", "c", "confidence")


@registered("SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.summary(table(spark, sf_dir, "documents"), ["lang", "source"])


@registered(
    "SELECT CASE WHEN l_quantity > 40 THEN 'critical' ELSE 'minor' END AS severity, code, count(*) AS n FROM (SELECT l_quantity, unnest(list_filter([CASE WHEN l_quantity > 40 THEN 'large' END, CASE WHEN l_discount = 0 AND l_quantity <= 40 THEN 'no_discount' END], lambda x: x IS NOT NULL)) AS code FROM lineitem) GROUP BY ALL"
)
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("critical", "large", F.col("l_quantity") > 40), ("minor", "no_discount", (F.col("l_discount") == 0) & (F.col("l_quantity") <= 40))]
    return audit.audit(audit.issues(table(spark, sf_dir, "lineitem"), "l_orderkey", rules))


@registered("SELECT term, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS term FROM (SELECT doc_id, %s AS t FROM documents)) GROUP BY term" % (_TOKENS % "text"))
def word_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.word_counts(table(spark, sf_dir, "documents"), tx.search_tokens(F.col("text")))


@registered(r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<script')) AS BIGINT) AS scripts, CAST(len(regexp_extract_all(html, '(?i)<a\s')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '(?i)<p[\s>]')) AS BIGINT) AS paragraphs FROM pages")
def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.findings(table(spark, sf_dir, "pages")).select("page_id", "scripts", "links", "paragraphs")


@registered(r"SELECT page_id, regexp_replace(trim(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '[^A-Za-z0-9]+', '-', 'g'), '-'), '^$', 'index') || '-' || substr(sha256(html), 1, 12) || '.html' AS snapshot_name FROM pages")
def page_snapshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.snapshot_name(F.col("url"), F.col("html")).alias("snapshot_name"))


@registered(r"SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*', 0) || '/The' AS rooted, 'http://a.example/x' AS absolute FROM pages")
def page_resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.resolve(F.col("url"), F.lit("/The")).alias("rooted"), html.resolve(F.col("url"), F.lit("http://a.example/x")).alias("absolute"))


@registered("SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS owners FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) > 1")
def many_owner_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_suppkey", "l_partkey").agg(F.count_distinct("l_orderkey").alias("owners")).where("owners > 1")


_TRIM = r"regexp_replace(trim(regexp_replace(replace(nfc_normalize(%s), chr(160), ' '), '\s+', ' ', 'g')), '^[ \t\r\n,.;:!?\-–—\x27\x22“”‘’]+|[ \t\r\n,.;:!?\-–—\x27\x22“”‘’]+$', '', 'g')"


@registered(
    rf"""WITH p AS (SELECT doc_id, text, source, lang, {_TRIM % "list_extract(regexp_extract_all(text, '[^.!?।;,]+'), 2)"} AS phrase FROM documents)
SELECT doc_id, instr(text, phrase) - 1 AS start_char, instr(text, phrase) - 1 + length(phrase) AS end_char, 'exact' AS method FROM p WHERE phrase <> '' AND contains(text, phrase)"""
)
def exact_phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's second clause, whole, found in its text as it stands; clauses that run over a line break are found loosely only."""
    clause = F.get(F.regexp_extract_all("text", F.lit(r"[^.!?।;,]+"), F.lit(0)), F.lit(1))
    rows = table(spark, sf_dir, "documents").withColumn("span", find_exact("text", clause)).where("span.method = 'exact'")
    return rows.select("doc_id", F.col("span.start").cast("bigint").alias("start_char"), F.col("span.end").cast("bigint").alias("end_char"), F.col("span.method").alias("method"))


@registered(None)
def phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's second clause as it is found in its text by any of the methods; held against brute force in the tests."""
    clause = F.get(F.regexp_extract_all("text", F.lit(r"[^.!?।;,]+"), F.lit(0)), F.lit(1))
    rows = table(spark, sf_dir, "documents").withColumn("span", find_exact("text", clause)).where("span.method is not null")
    return rows.select("doc_id", F.col("span.start").cast("bigint").alias("start_char"), F.col("span.end").cast("bigint").alias("end_char"), F.col("span.method").alias("method"))


@registered("SELECT lang, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY lang")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.group_statistics(table(spark, sf_dir, "documents"), "lang", "n_chars")


@registered("SELECT count(n_chars) AS n, min(n_chars) AS low, max(n_chars) AS high, CAST(quantile_cont(n_chars, 0.5) AS DOUBLE) AS median FROM documents")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.score_summary(table(spark, sf_dir, "documents"), "n_chars").select("n", "low", "high", "median")


@registered("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def source_language_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.crosstab(table(spark, sf_dir, "documents"), "source", "lang", ["en", "fr", "de", "es"])


@registered("SELECT b, count(*) AS n FROM (SELECT CASE WHEN n_chars < 500 THEN '<500' WHEN n_chars < 2000 THEN '500-2000' WHEN n_chars < 5000 THEN '2000-5000' ELSE '>=5000' END AS b FROM documents) GROUP BY b")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(reports.bucket(F.col("n_chars"), [500, 2000, 5000]).alias("b"))
    return rows.groupBy("b").agg(F.count("*").alias("n"))


@registered(
    r"""SELECT conv_id, turn, 'record_' || conv_id || '_' || turn AS record_id, CASE WHEN role = 'assistant' THEN 'partial_commentary' ELSE 'no_commentary' END AS extraction_status,
  lpad(CAST(conv_id AS VARCHAR), CAST(greatest(4, length(CAST(conv_id AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(turn AS VARCHAR), 4, '0') AS rank_key FROM conversations"""
)
def enriched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select("text", F.when(F.col("role") == "assistant", F.col("text")).alias("note"), F.lit("").alias("gloss"), "role", F.col("conv_id").cast("string").alias("c"), F.col("turn").cast("string").alias("t"))
    out = records.enriched(rows, "text", "note", "gloss", "role", "role", "c", "t")
    return out.select(F.col("hymn_id").cast("bigint").alias("conv_id"), F.col("song_no").cast("bigint").alias("turn"), "record_id", "extraction_status", "rank_key")


@registered("SELECT CAST(doc_id AS VARCHAR) AS key, 'source' AS field, 'wrong_type' AS problem FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 'author', 'absent' FROM documents")
def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.contract(table(spark, sf_dir, "documents"), "doc_id", {"doc_id": "bigint", "text": "string", "source": "int", "author": "string"})
