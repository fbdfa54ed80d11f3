"""Scans and sinks of the artifact formats: JSON lines, registries, CSV and TSV packs, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.records import digest_of


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, limit: int | None = None) -> DataFrame:
    """JSON lines; a schema makes the scan one pass. A row that can't be read is null in all but `_corrupt_record`, if the schema has that."""
    reader = spark.read.option("mode", "PERMISSIVE")
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows.limit(limit) if limit is not None else rows


def read_optional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, or an empty table where there is no such path."""
    try:
        return read_jsonl(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_tables(spark: SparkSession, folder: str, schemas: dict[str, str]) -> tuple[dict[str, DataFrame], list[dict]]:
    """Tables by name, and an issue for each that is missing; those are empty."""
    tables, issues = {}, []
    for name, schema in schemas.items():
        try:
            tables[name] = read_jsonl(spark, f"{folder}/{name}.jsonl", schema)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            tables[name] = spark.createDataFrame([], schema)
            issues.append({"severity": "critical", "code": "missing_table", "key": name})
    return tables, issues


def with_source(rows: DataFrame, pattern: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """rows with the name of the file that each came from."""
    return rows.withColumn("corpus_id", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_registry(spark: SparkSession, path: str, priority: int = 0) -> DataFrame:
    """Records of one registry document with the registry's name and its place in the order of registries."""
    doc = spark.read.json(path, multiLine=True)
    return doc.select("registry_name", F.lit(priority).alias("priority"), F.explode("records").alias("record")).select("registry_name", "priority", "record.*")


def read_registries(spark: SparkSession, paths: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_registry(spark, p, i) for i, p in enumerate(paths)])


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A headed CSV or TSV of texts; a byte-order mark before the first name goes."""
    rows = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def split_cells(column, sep: str = "|"):
    """A packed cell as an array without empty parts."""
    return F.filter(F.transform(F.split(column, f"[{sep}]", -1), lambda x: F.trim(x)), lambda x: x != "")


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with columns in the order of their names."""
    rows.select(*sorted(rows.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_delimited(rows: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    rows.select(*sorted(rows.columns)).write.mode(mode).option("header", True).option("sep", sep).csv(path)


def content_digest(rows: DataFrame) -> DataFrame:
    """rows, checksum: a digest of a table that does not depend on the order of its rows."""
    return rows.agg(F.count("*").alias("rows"), digest_of(rows).alias("checksum"))


def write_once(rows: DataFrame, path: str) -> str:
    """created, or reused where the same rows are there; anything else there is refused."""
    spark = rows.sparkSession
    try:
        old = spark.read.schema(rows.schema).parquet(path)
        old.take(1)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows.write.parquet(path)
        return "created"
    if content_digest(old).first() != content_digest(rows).first():
        raise FileExistsError(f"other rows are at {path}")
    return "reused"
