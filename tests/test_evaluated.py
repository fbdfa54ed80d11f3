"""Expected documents of benchmark items that end or begin inside a word, whole texts against the registered SQL."""

import duckdb
import pytest

from corpusloom.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("evaluated"))
    cut = "one two red sun six ten old sky far sea low ice may vonschveroedentlich ends"
    begins = "tinuationally it is so as we go on in it to be or if at no my up by"
    single = "x" * 70
    items = [(1, cut), (2, begins), (3, single), (4, "nothing holds this phrase of an item at all, not even one record"), (5, None)]
    docs = [(1, f"say {cut} here"), (2, f"con{begins} here"), (3, f"yy {single}"), (4, f"a{single}b"), (5, None), (6, "other words"), (7, cut[:70])]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["recall_mrr", "failure_attribution"])
def test_query_equals_its_sql(spark, folder, name):
    duck = duckdb.connect()
    for table in ("benchmark", "documents"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    answer = duck.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    rows = QUERIES[name](spark, folder).select(columns).collect()
    assert sorted(map(tuple, rows)) == sorted(answer.fetchall())
    if name == "failure_attribution":
        assert [r.failure for r in sorted(rows)][:2] == ["passed", "passed"]
