"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Every document gets counts and one score in permille: the largest of several weighted shares (symbols, exclamation marks,
capitals, digits, repeated words and lines). Within each stratum the cutoffs of a fixed grid are tested from the loosest
to the strictest on labelled good documents: with n of them, k of which the cutoff would reject, the exact binomial
probability of k or fewer rejections at a rate of RISK must not exceed the level. The first cutoff that fails ends the
sequence and the last that passed is taken, which needs no correction within a stratum; the level is CONFIDENCE's
complement divided by the number of strata that have labels (Bonferroni). With that confidence no stratum's rule rejects more than RISK of good documents;
a stratum with too few labels gets no cutoff and loses only what fails the base rules.

Trials must be independent: a text counts once in its stratum, however many labelled copies of it there are.

A null text has no words and fails the base rules. Rows with a null stratum are a stratum. A null label counts for
nothing; of repeated labels of a document the best counts. Repeated rows are judged one by one, also those that share a
doc_id or have none. An empty table has no result rows; without labels there are no cutoffs. Only doc_id, text and the
stratum are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, semi_by_size, word_array

RISK, CONFIDENCE = 0.02, 0.95
CUTOFFS = (900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 220, 200, 180, 160, 140, 120, 100, 90, 80, 70, 60, 50, 40, 30, 20)
LEAST_WORDS = 50
#: Above every score.
NO_CUTOFF = 1_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _count(chars: str) -> F.Column:
    return (F.length("text") - F.length(F.translate(F.col("text"), chars, ""))).cast("bigint")


def digest(text) -> F.Column:
    """16 bytes that name a text; null as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def features(documents: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, content (digest of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score."""
    rows = documents.select("doc_id", F.col(stratum).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", word_array(F.col("text")))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    many = F.size("words") > 2
    triples = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"), F.slice("words", 3, F.greatest(F.size("words"), F.lit(1))).alias("c"))
    windows = F.slice(F.transform(triples, lambda x: F.xxhash64(x["a"], x["b"], x["c"])), 1, F.size("words") - 2)
    rows = rows.withColumn("windows", F.when(many, windows).otherwise(F.array().cast("array<bigint>")))
    # Windows sorted by hash with their places: equal neighbours are found twice or more. The hash stands for the three words.
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.size("windows") > F.size(F.array_distinct("windows")), placed))
    next_to = F.arrays_zip(F.col("placed").alias("a"), F.slice("placed", 2, F.greatest(F.size("placed"), F.lit(1))).alias("b"))
    equal = F.filter(next_to, lambda x: x["a"]["h"] == x["b"]["h"])
    covered = F.flatten(F.transform(equal, lambda x: F.array(*[x[s]["i"] + k for s in "ab" for k in range(3)])))
    counts = rows.select(
        "doc_id", "stratum", digest(F.col("text")).alias("content"),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        _count("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("placed").isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"), _count("!").alias("n_shouts"), _count(UPPER).alias("n_capitals"), _count("0123456789").alias("n_digits"),
    )
    share = lambda part, whole, weight: F.expr(f"{1000 * weight} * {part} div greatest({whole}, 1)")
    score = F.greatest(
        share("n_symbols", "word_chars", 3), share("n_shouts", "word_chars", 4), share("n_capitals", "word_chars", 1),
        share("n_digits", "word_chars", 1), share("n_repeat_words", "n_words", 1), share("n_dup_lines", "n_lines", 1),
    )
    return counts.withColumn("score", score).drop("n_lines", "n_shouts", "n_capitals", "n_digits")


def log_binomial_tail(n, k, rate: float) -> F.Column:
    """ln P(X <= k) for X of n trials at the rate, from the first term on by ratios, in logarithms."""
    start = n * F.log(F.lit(1 - rate))
    step = F.lit(rate / (1 - rate))
    total = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1).cast("bigint"))),
        F.struct(start.alias("term"), start.alias("sum")),
        lambda acc, i: F.struct(
            (acc["term"] + F.log((n - i + 1) / i * step)).alias("term"),
            (acc["sum"] + F.log1p(F.exp(acc["term"] + F.log((n - i + 1) / i * step) - acc["sum"]))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(k <= 0, start).otherwise(total)


def cutoffs(scored: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """stratum, cutoff of those strata in which a cutoff is proven to reject at most `risk` of good documents.

    scored: doc_id, stratum, content, score; rows of equal content in a stratum are one trial.
    """
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = scored.join(good, "doc_id").select("stratum", "content", "score").distinct()
    counts = held.groupBy("stratum").agg(
        F.count("*").alias("n"),
        F.array(*[F.struct(F.lit(c).alias("cutoff"), F.count_if(F.col("score") >= c).alias("k")) for c in CUTOFFS]).alias("tests"),
    )
    counts = counts.withColumn("strata", F.count("*").over(Window.partitionBy()))
    tests = counts.select("stratum", "n", "strata", F.inline("tests"))
    passes = (F.col("k") < risk * F.col("n")) & (log_binomial_tail(F.col("n"), F.when(F.col("k") < risk * F.col("n"), F.col("k")).otherwise(F.lit(0)), risk) <= F.log((1 - confidence) / F.col("strata")))
    failed = F.max(F.when(~passes, F.col("cutoff"))).over(Window.partitionBy("stratum"))
    tests = tests.select("stratum", "cutoff", failed.alias("failed"))
    return tests.where("failed is null or cutoff > failed").groupBy("stratum").agg(F.min("cutoff").alias("cutoff"))


def judged_rows(documents: DataFrame, labels: DataFrame, stratum: str, risk: float, confidence: float) -> DataFrame:
    """features of every row of documents with base_failed, cutoff and kept."""
    scored = checkpointed(features(documents, stratum))
    limits = cutoffs(scored, labels, risk, confidence).withColumnRenamed("stratum", "of")
    rows = scored.join(limits, scored["stratum"].eqNullSafe(limits["of"]), "left")
    failed = F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words")
    cutoff = F.coalesce(F.col("cutoff"), F.lit(NO_CUTOFF)).cast("bigint")
    return rows.withColumns({"base_failed": failed, "kept": ~(failed | (F.col("score") >= cutoff)), "cutoff": cutoff})


def quality_verdicts(documents: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, the counts, base_failed, score, cutoff and kept of every row of documents."""
    return judged_rows(documents, labels, stratum, risk, confidence).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "cutoff"
    )


def good_documents(documents: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """documents without the rows that are rejected, each judged by its own text and stratum."""
    scored = checkpointed(judged_rows(documents, labels, stratum, risk, confidence).where("not kept").select("doc_id", "content", "stratum").distinct())
    key = {"doc_id": F.col("doc_id"), "content": digest(F.col("text")), "stratum": F.col(stratum)}
    return semi_by_size(documents, scored, key, "left_anti")
