"""The pipeline's stages, one after the other, against what each promises."""

from pyspark.sql.functions import lit

import corpus_pipeline
from corpusloom.llm import decontaminate, near_dedup, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "source_mix":
            assert out.columns == columns
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        kept[name], docs = out, out
    assert 0 < kept["near_dedup"].count() <= kept["quality_rules"].count()
    assert all(r.kept for r in near_dedup.near_duplicates(kept["near_dedup"]).collect())
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    before = decontaminate.contamination(kept["near_dedup"], benchmark).where("contaminated").count()
    after = decontaminate.contamination(kept["decontaminate"], benchmark).where("contaminated").count()
    assert after == 0 <= before
    assert secret_scan.findings_of(secret_scan.scan(kept["secret_scan"])).count() == 0
    assert kept["source_mix"].where("copies < 1 or copies > 3").count() == 0


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"copies", "taken"} <= set(out.columns)


ODD = [
    (None, None, None, None, None), (1, "", "en", "a", 0), (None, "word " * 80, None, None, None), (2, "one two three. " * 3 + " ".join(f"w{i}" for i in range(90)), "en", None, 7),
    (2, " ".join(f"v{i}" for i in range(90)), "en", "b", 7), (None, " ".join(f"u{i}" for i in range(20_000)), "de", "b", None), (None, " ".join(f"t{i}" for i in range(90)), None, "", None),
]


def test_each_stage_takes_odd_and_empty_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = spark.createDataFrame([tuple(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)).get(c) for c in schema.names) for r in [*ODD, ODD[3]]], schema)
    clashing = rows.withColumns({c: lit("x") for c in ("content", "class", "kept", "size_", "stratum", "blob", "node")})
    for name, stage in corpus_pipeline.STAGES:
        for docs in (rows, clashing):
            assert stage(spark, docs.limit(0), SF).count() == 0
            out = stage(spark, docs, SF)
            assert set(docs.columns) <= set(out.columns) and out.count() <= rows.count()
        texts = {r.text for r in stage(spark, rows, SF).collect()}
        assert {ODD[3][1], ODD[4][1], ODD[5][1], ODD[6][1]} <= texts or name == "source_mix"


def test_stage_folders_go(spark):
    import os

    corpus_pipeline.run(spark, SF)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert all(len(os.listdir(f"{folder}/{x}")) == 1 for x in os.listdir(folder) if x.startswith("pipeline-"))
