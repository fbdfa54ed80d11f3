"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed: its blob is the SHA-256 of its text, so equal contents are one blob.
The ledger has a row for each scan of a blob: the rule versions that were run and all that they found. `extended` takes one
text of each blob (chosen while rows are still where they were read, so that a blob with very many paths moves once for
each task), runs only the rules that the ledger lacks for it and returns the ledger with the new rows, which the next
increment is given. Findings of all scans, old and new, are joined back to all paths.

A rule is a pattern with a least length for one of its groups: matches are taken leftmost and without overlap, and those
whose group is too short are dropped without another try. Spans count code points, end exclusive. Positions come from
running sums of the pieces between matches, so a text with any number of matches stays linear.

A null text is empty. Repeated rows are paths with one blob. An empty table adds nothing to the ledger and has no result
rows. Findings of rule versions that are no longer asked for stay in the ledger and out of the result. Columns other than
the path and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_BYTES, checkpointed, free_name


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Kinds in the order in which equal starts are listed. A run of a class that is long enough is the same as the class's
#: run with a check of its length; only `assign` needs the check after the match.
RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = ("assign", "access", "hex")


def blob_of(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _lengths(rule: Rule) -> F.Column:
    """Lengths of the piece before each match, of the match and of its measured group; empty where nothing matches."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    pieces = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(pieces.alias("p"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("g"))
    sizes = F.transform(parts, lambda x: F.struct(F.length(x["p"]).alias("piece"), F.length(x["m"]).alias("size"), F.length(x["g"]).alias("measured")))
    return F.when(text.rlike(rule.pattern), sizes).otherwise(F.array().cast("array<struct<piece:int,size:int,measured:int>>"))


LEDGER = "blob string, rules array<string>, findings array<struct<rule: string, start: bigint, end: bigint>>"


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rules, findings) of versions' texts: only what the ledger lacks is run."""
    texts = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("rules", keys)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("rules") > 0)
    empty = F.array().cast("array<struct<piece:int,size:int,measured:int>>")
    found = [F.struct(F.lit(n).alias("no"), F.when(F.array_contains("rules", r.key), _lengths(r)).otherwise(empty).alias("parts")) for n, r in enumerate(rules)]
    # One row for each piece between matches, and one for a blob without any match, so that each blob comes out.
    rows = blobs.select("blob", "rules", F.explode_outer(F.filter(F.array(*found), lambda x: F.size(x["parts"]) > 0)).alias("f"))
    rows = rows.select("blob", "rules", F.col("f.no").alias("no"), F.posexplode_outer("f.parts").alias("at", "part")).select("blob", "rules", "no", "at", "part.*")
    order = Window.partitionBy("blob", "no").orderBy("at")
    rows = rows.withColumn("end", F.sum(F.col("piece").cast("bigint") + F.coalesce("size", F.lit(0))).over(order))
    least = F.array(*[F.lit(r.least) for r in rules])
    long_enough = F.col("size").isNotNull() & (F.col("measured") >= F.get(least, F.col("no")))
    finding = F.struct(F.get(keys, F.col("no")).alias("rule"), (F.col("end") - F.col("size")).alias("start"), F.col("end"))
    return rows.groupBy("blob").agg(F.first("rules").alias("rules"), F.collect_list(F.when(long_enough, finding)).alias("findings"))


def extended(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with what it lacked of versions' texts; with None, the first ledger."""
    fresh = checkpointed(scan(versions, ledger, rules))
    return fresh if ledger is None else ledger.unionByName(fresh)


def findings_of(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, kind_no, kind, start, end of all that the ledger holds for the rules."""
    rule = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(n).alias("no"), F.lit(r.kind).alias("kind")))])
    rows = ledger.where(F.size("findings") > 0).select("blob", F.inline("findings")).withColumn("of", rule[F.col("rule")]).where("of is not null")
    return rows.select("blob", F.col("of.no").alias("kind_no"), F.col("of.kind").alias("kind"), "start", "end").distinct()


def listed(findings: DataFrame, base: tuple[str, ...] = BASE) -> DataFrame:
    """One row a blob: counts of the base kinds, digest of the base spans, and all spans as text."""
    item = F.struct("start", "kind_no", F.concat_ws(":", "kind", "start", "end").alias("span"), F.col("kind").isin(*base).alias("base"))
    by_blob = findings.groupBy("blob").agg(
        F.array_sort(F.collect_list(item)).alias("all"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base]
    )
    return by_blob.select(
        "blob", *[f"n_{k}" for k in base],
        F.sha2(F.array_join(F.filter("all", lambda x: x["base"])["span"], ","), 256).alias("base_sha256"),
        F.array_join(F.col("all")["span"], ",").alias("spans"),
    )


def joined(documents: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of documents (doc_id, text), read from the ledger."""
    paths = documents.select("doc_id", blob_of(F.col("text")).alias("blob"))
    by_blob = checkpointed(listed(findings_of(ledger, rules)))
    if (by_blob.agg(F.sum(256 + F.length("spans"))).first()[0] or 0) <= BROADCAST_BYTES:
        by_blob = F.broadcast(by_blob)  # else a blob with very many paths would meet them in one task, unless Spark splits it
    out = paths.join(by_blob, "blob", "left")
    none = {f"n_{k}": F.coalesce(f"n_{k}", F.lit(0).cast("bigint")) for k in BASE}
    return out.withColumns(none | {"base_sha256": F.coalesce("base_sha256", F.sha2(F.lit(""), 256)), "spans": F.coalesce("spans", F.lit(""))}).drop("blob")


def secrets(documents: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`joined` of documents after the ledger is extended by them: the same result with any earlier ledger."""
    return joined(documents, extended(documents.select("text"), ledger, rules), rules)


def redacted(documents: DataFrame, mark: str = "[secret]", ledger: DataFrame | None = None) -> DataFrame:
    """documents with every finding replaced by mark; overlapping findings by one. n_chars, if there, follows."""
    findings = findings_of(extended(documents.select("text"), ledger))
    order = Window.partitionBy("blob").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = findings.withColumn("run", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("run").over(order)).groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = runs.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    blob, found = free_name("found_blob", documents), free_name("found_cuts", documents)
    cuts = checkpointed(cuts.select(F.col("blob").alias(blob), F.col("cuts").alias(found)))
    bytes_held = cuts.agg(F.sum(96 + 16 * F.size(found))).first()[0] or 0
    cuts = F.broadcast(cuts) if bytes_held <= BROADCAST_BYTES else cuts
    rows = documents.join(cuts, blob_of(F.col("text")) == F.col(blob), "left")
    edges = F.arrays_zip(
        F.concat(F.array(F.lit(0).cast("bigint")), F.col(found)["end"]).alias("low"),
        F.concat(F.col(found)["start"], F.array(F.length("text").cast("bigint"))).alias("high"),
    )
    kept = F.transform(edges, lambda x: F.substring(F.col("text"), (x["low"] + 1).cast("int"), (x["high"] - x["low"]).cast("int")))
    new = {"text": F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(kept, mark))}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length(new["text"]).cast("bigint"))
    return rows.withColumns(new).select(documents.columns)
