"""The thin opN_ queries: each applies one operator to its whole table and returns the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import oracles
from corpusloom.llm.chat_format import packs, read_back
from corpusloom.llm.decontaminate import contamination
from corpusloom.llm.lm_score import scores
from corpusloom.llm.near_dedup import near_duplicates
from corpusloom.llm.pii import personal_data
from corpusloom.llm.quality_rules import quality_verdicts
from corpusloom.llm.secret_scan import extended, joined
from corpusloom.llm.source_mix import mix
from corpusloom.llm.url_filter import judged
from corpusloom.llm.weak_quality import quality_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments over one ledger: what the first has scanned is not scanned again, and both are joined back to all rows."""
    documents = table(spark, sf_dir, "documents")
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    ledger = extended(documents.where(early))
    return joined(documents, extended(documents.where(~early), ledger))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], conversations.schema)
    return read_back(packs(conversations.unionByName(extra)))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_chat_format": op4_chat_format,
    "op5_weak_quality": op5_weak_quality,
    "op6_source_mix": op6_source_mix,
    "op7_decontaminate": op7_decontaminate,
    "op8_lm_score": op8_lm_score,
    "op9_pii": op9_pii,
    "op10_url_filter": op10_url_filter,
}

ORACLES = {
    "op1_near_dedup": oracles.OP1,
    "op2_secret_scan": oracles.OP2,
    "op3_quality_rules": oracles.OP3,
    "op4_chat_format": oracles.OP4,
    "op6_source_mix": oracles.OP6,
    "op7_decontaminate": oracles.OP7,
    "op9_pii": oracles.OP9,
    "op10_url_filter": oracles.OP10,
}
