"""URL filters by a path-template tree of every host, in DataFrame operations only.

Fixed rules (host and path prefix) come first: a rule fits its host and all subdomains when the path starts with the
rule's; the longest wins. Urls that a rule judges are also the labelled examples.

Each host's paths become a tree of segments. Runs of digits in a segment generalise to `0`; below each node, children that
are rare where there are many kinds of them become one wildcard `*`. Sibling branches are ordered by purity, the labelled share of
allowed urls, and neighbours whose shares do not differ significantly (two-proportion z test) are merged. A branch's
purity is smoothed towards its parent's, the parent's towards its own parent's, up to the host and all hosts; a url
without a rule is blocked when its deepest template's smoothed purity is below REJECT_BELOW.

Counts are summed by shape of path first; sums of a host and of a node's children are aggregates that join back, so that
a host with a third of all urls, each with a segment of its own, is nowhere gathered. Siblings are ordered only after they were generalised, when
a node has at most max(MANY, 1 / RARE) + 2 of them. Segments from `levels` on form one last segment. A null url, or one without
`://`, has an empty host and path, no rule, and is allowed unless its template's purity says otherwise. Urls of any length are
taken whole. Repeated rows are judged one by one; equal shares are ordered by segment. An empty table has no result rows. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import by_size, checkpointed

#: (verdict, host, path prefix); fixed values
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LEVELS = 4
#: Below a node with more than MANY kinds of children, those with less than RARE of its urls are one wildcard.
MANY, RARE = 16, 0.05
SMOOTH, Z, REJECT_BELOW = 8.0, 1.96, 0.2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise(F.lit(""))
    rows = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    return rows.select(
        "page_id", F.translate(F.regexp_extract("rest", "^([^/?#]*)", 1), _UPPER, _LOWER).alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path")
    )


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """rows with rule and its verdict, both null where none fits; longer rules are asked first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, f"{host}{path}").otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rows.withColumns({"rule": rule, "ruled": verdict})


def _merged(nodes: DataFrame) -> DataFrame:
    """Nodes of one level with the purity of their group of similar siblings. nodes: parent key columns, urls, allowed, labelled, prior."""
    siblings = Window.partitionBy("host", "parent")
    smooth = (F.col("allowed") + SMOOTH * F.col("prior")) / (F.col("labelled") + SMOOTH)
    order = siblings.orderBy("share", "segment")
    rows = nodes.withColumn("share", smooth)
    rows = rows.withColumns({"allowed_before": F.lag("allowed").over(order), "labelled_before": F.lag("labelled").over(order)})
    pooled = (F.col("allowed") + F.col("allowed_before")) / (F.col("labelled") + F.col("labelled_before"))
    spread = pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / F.col("labelled_before"))
    gap = F.col("allowed") / F.col("labelled") - F.col("allowed_before") / F.col("labelled_before")
    both = (F.col("labelled") > 0) & (F.col("labelled_before") > 0)
    apart = F.col("labelled_before").isNull() | F.when(both, gap * gap > Z * Z * spread).otherwise((F.col("labelled") > 0) != (F.col("labelled_before") > 0))
    rows = rows.withColumn("apart", F.when(apart, 1).otherwise(0))
    rows = rows.withColumn("branch", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("host", "parent", "branch")
    purity = (F.sum("allowed").over(group) + SMOOTH * F.col("prior")) / (F.sum("labelled").over(group) + SMOOTH)
    return rows.withColumn("purity", purity)


def template_tree(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """host, shape, template, purity of every shape of path. rows: host, shape (array of segments), ruled.

    levels: segments that are told apart; a tree of deeper paths needs a larger one, at the price of two joins a level.
    """
    counted = rows.groupBy("host", "shape").agg(
        F.count("*").cast("double").alias("urls"), F.count_if(F.col("ruled") == "allow").cast("double").alias("allowed"), F.count("ruled").cast("double").alias("labelled")
    )
    counted = checkpointed(counted)
    every = counted.agg(F.sum("allowed").alias("a"), F.sum("labelled").alias("n")).first()
    overall = ((every.a or 0.0) + SMOOTH) / ((every.n or 0.0) + SMOOTH)
    hosts = counted.groupBy("host").agg(((F.sum("allowed") + SMOOTH * F.lit(overall)) / (F.sum("labelled") + SMOOTH)).alias("prior"))
    shapes = counted.join(by_size(hosts, 128), "host")
    shapes = shapes.withColumn("template", F.lit(""))
    for level in range(levels):
        segment = F.coalesce(F.get("shape", F.lit(level)), F.lit("")) if level < levels - 1 else F.array_join(F.slice("shape", levels, 1 << 30), "/")
        shapes = shapes.withColumn("segment", segment).withColumnRenamed("template", "parent")
        nodes = shapes.groupBy("host", "parent", "segment").agg(
            *[F.sum(c).alias(c) for c in ("urls", "allowed", "labelled")], F.max("prior").alias("prior")
        )
        parents = nodes.groupBy("host", "parent").agg(F.count("*").alias("kinds"), F.sum("urls").alias("all_urls"))
        rare = (F.col("kinds") > MANY) & (F.col("urls") < RARE * F.col("all_urls")) & (F.col("segment") != "")
        nodes = checkpointed(nodes.join(parents, ["host", "parent"]).withColumn("general", F.when(rare, "*").otherwise(F.col("segment"))).drop("kinds", "all_urls"))
        names = nodes.select("host", "parent", "segment", "general")
        nodes = nodes.groupBy("host", "parent", F.col("general").alias("segment")).agg(
            *[F.sum(c).alias(c) for c in ("urls", "allowed", "labelled")], F.max("prior").alias("prior")
        )
        judged = _merged(nodes).select("host", "parent", F.col("segment").alias("general"), "purity")
        shapes = shapes.drop("prior").join(names, ["host", "parent", "segment"]).join(judged, ["host", "parent", "general"])
        shapes = checkpointed(
            shapes.select("host", "shape", "urls", "allowed", "labelled", F.concat_ws("/", "parent", "general").alias("template"), F.col("purity").alias("prior"))
        )
    return shapes.select("host", "shape", F.rtrim("template", F.lit("/")).alias("template"), F.col("prior").alias("purity"))


def judged(pages: DataFrame, rules=RULES, levels: int = LEVELS) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of pages (page_id, url)."""
    rows = ruled(parsed(pages), rules)
    trimmed = F.regexp_replace(F.regexp_replace("path", r"^/+", ""), "[0-9]+", "0")
    rows = rows.withColumn("shape", F.split(trimmed, "/", -1))
    tree = template_tree(rows, levels).select("host", "shape", "template", "purity")
    rows = rows.join(tree, ["host", "shape"], "left")
    by_method = F.when(F.col("purity") < REJECT_BELOW, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
