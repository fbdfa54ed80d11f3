"""The opN_ queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from corpusloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    answer = duck.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    frame = QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(columns)
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in frame.collect())
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in answer.fetchall())


@pytest.mark.parametrize("name", ["op5_weak_quality", "op8_lm_score", "op9_pii"])
def test_query_without_sql_has_a_row_a_document(spark, name):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
