"""Every registered query of the library against its SQL on the smallest tables, and goldens for what SQL can't say."""

import math

import duckdb
import pytest

from corpusloom.operators import alignment, retrieval
from corpusloom.plans import links_catalogue, more_catalogue  # noqa: F401  they register their queries
from corpusloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    answer = duck.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert sorted(frame.columns) == sorted(columns)
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in frame.collect())
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_titles_cut_within_a_reference(spark, tmp_path):
    titles = ["a&amp;&amp;&amp", "b &am", "c &", "d &ampx &lt &lt; &#39 &#39; &copy; &copy", "&amp;lt; &amp;amp; &&amp;amp;", "&nbsp;&quot;e&quot &gt;f", "&amp", None, ""]
    rows = [(i, "http://h.org/", None if t is None else f"<html><head><title>{t}</title></head><body><p>x &amp y</p></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["page_records"](spark, str(tmp_path)).collect())
    answer = duckdb.connect()
    answer.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(answer.execute(ORACLES["page_records"]).fetchall()) and got[0][1] == "a&&&amp"


def test_paths():
    lines = [[(1, 1, 0.5), (2, 2, 0.4)], [(1, 1, 0.6), (2, 2, 0.55)], [(3, 3, 0.3), (1, 1, 0.9)]]
    assert alignment.monotone_path(lines) == [0, 1, 0]
    assert alignment.monotone_path(lines[::-1], reverse=True) == [0, 1, 0]
    assert alignment.assignment(lines) == [1, 1, 1] or sum(lines[i][k][2] for i, k in enumerate(alignment.assignment(lines))) == pytest.approx(1.35)
    assert alignment.transition((2, 3), (3, 4)) is None and alignment.transition((1, 1), (4, 4)) == 0.04


def test_expansion():
    found = retrieval.expand("where is the forma", [("synonyms", [{"id": "s1", "canonical": "the", "related": ["les"]}, {"id": "s2", "canonical": "form", "related": []}])])
    assert found["text"] == "where is the les forma" and found["expanded_terms"] == ["the", "les"] and [r["record_id"] for r in found["rules"]] == ["s1"]


def test_lexical_search(spark):
    columns = "record_id string, verse string, pozhppurai string, kurippurai string, search_text string, metadata string, song_no string, hymn_id string, hymn_title string, author string, pann string, extraction_status string, rank_key string"
    rows = [("r_1_1", "red moon", "", "", "red moon", "m", "1", "1", "Moon song", "x", "p", "partial_commentary", "1"), ("r_1_2", "blue sun", "moon note", "", "blue sun moon note", "m", "2", "1", "Sun", "y", "p", "complete", "2")]
    chunks = spark.createDataFrame([("r_1_1_verse_only", "r_1_1", ["moon", "red"], "1"), ("r_1_2_verse_only", "r_1_2", ["blue", "sun"], "2")], "chunk_id string, parent_record_id string, unique_terms array<string>, rank_key string")
    records = spark.createDataFrame(rows, columns)
    got = retrieval.lexical_search("moon", records, chunks).collect()
    assert [(r.rank, r.record_id, r.score) for r in got] == [(1, "r_1_1", 700 + 400 + 100), (2, "r_1_2", 600 + 400)]
    assert [r.record_id for r in retrieval.lexical_search("moon", records, chunks, {"author": "y", "unknown": 1}).collect()] == ["r_1_2"]
    assert [r.score for r in retrieval.lexical_search("partial_commentary", records, chunks).collect()] == [7500]


def test_hybrid_takes_the_last_lexical_chunk(spark):
    lexical = spark.createDataFrame([(1, 1, "a", "a_x", 900, ["verse"]), (1, 2, "a", "a_y", 300, ["verse"]), (1, 3, "b", "b_x", 300, ["verse"])], "query_id int, rank int, record_id string, chunk_id string, score int, matched_fields array<string>")
    semantic = spark.createDataFrame([(1, 1, "b", "b_z", 0.8)], "query_id int, rank int, record_id string, chunk_id string, similarity double")
    got = {r.record_id: r for r in retrieval.hybrid(lexical, semantic).collect()}
    assert got["a"].chunk_id == "a_y" and got["a"].lexical_norm == pytest.approx(1 / 3) and got["a"].lexical_score == 900
    assert got["b"].matched_modes == "both" and got["b"].hybrid_score == pytest.approx(0.65 / 3 + 0.35 + 0.05) and got["b"].rank == 1
