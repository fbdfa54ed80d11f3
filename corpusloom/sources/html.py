"""Row generators over raw pages: links, titles, tables, forms and page types by expressions; element trees by a parser.

Expressions serve what a pattern can say and stay in the JVM. `elements` runs the standard library's parser in Arrow
batches for what needs nesting.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def strip_tags(html) -> Column:
    """Visible text of a fragment: no scripts, styles, comments or tags, entities of the basic five resolved."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, link_no (from 0), href, anchor of every `<a href>` in order."""
    whole = F.regexp_extract_all(F.col(html), F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(0))
    rows = pages.select(key, F.posexplode(whole).alias("link_no", "tag"))
    return rows.select(key, "link_no", F.regexp_extract("tag", r'(?is)href="([^"]*)"', 1).alias("href"), strip_tags(F.col("tag")).alias("anchor"))


def resolve(base, href) -> Column:
    """href made absolute against a page's url, for absolute, rooted and plain relative references."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[^?#]*", 0), r"(?<!/)/[^/]*$", "/")
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^[^:]*:", 0), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))


def title(html) -> Column:
    return strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def frames(html) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<i?frame\s[^>]*?src="([^"]*)"'), F.lit(1))


def is_frameset(html) -> Column:
    return F.contains(F.lower(F.substring(html, 1, 5000)), F.lit("<frameset"))


def handlers(html) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)\son[a-z]+="([^"]*)"'), F.lit(1))


def forms(html) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<form\s[^>]*?action="([^"]*)"'), F.lit(1))


def page_type(url) -> Column:
    """Page type by ordered predicates on path and query."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return (
        F.when(F.contains(query, F.lit("page=")), "listing").when(path.rlike(r"^/?$"), "home").when(path.endswith(".html"), "document")
        .when(path.endswith("/"), "directory").when(path.rlike(r"/[0-9]+$"), "record").otherwise("other")
    )


def snapshot_name(url, html) -> Column:
    """Slug of the url's path with twelve hex digits of the content's hash."""
    slug = F.btrim(F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), r"[^A-Za-z0-9]+", "-"), F.lit("-"))
    return F.concat(F.coalesce(tx.missing(slug), F.lit("index")), F.lit("-"), F.substring(F.sha2(html, 256), 1, 12), F.lit(".html"))


def findings(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Counts of what a page holds, and whether its text can be had without running it."""
    html = F.col("html")
    count = lambda p: F.regexp_count(html, F.lit(p)).cast("bigint")
    rows = pages.select(key, count("(?i)<script").alias("scripts"), count("(?i)<a\\s").alias("links"), count("(?i)<form").alias("forms"), F.size(handlers(html)).cast("bigint").alias("handlers"), count("(?i)<p[\\s>]").alias("paragraphs"))
    return rows.withColumn("static", F.col("paragraphs") > 0)


class _Tree(HTMLParser):
    """Elements in document order with tag, depth and own text; `skip` are left out with all they hold."""

    def __init__(self, skip: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[tuple[str, int]] = []
        self.skip, self.hidden = skip, 0

    def handle_starttag(self, tag, attrs):
        if tag in self.skip:
            self.hidden += 1
        elif not self.hidden:
            self.rows.append([tag, len(self.stack), ""])
            if tag not in ("br", "img", "meta", "link", "input", "hr"):
                self.stack.append((tag, len(self.rows) - 1))

    def handle_endtag(self, tag):
        if tag in self.skip:
            self.hidden = max(0, self.hidden - 1)
        elif any(t == tag for t, _ in self.stack):
            while self.stack and self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.hidden and self.stack and data.strip():
            row = self.rows[self.stack[-1][1]]
            row[2] = f"{row[2]} {' '.join(data.split())}".strip()


def elements(pages: DataFrame, key: str = "page_id", html: str = "html", skip: tuple[str, ...] = ("script", "style")) -> DataFrame:
    """key, element_no, tag, depth, own_text of each element of each page, in document order."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, text in zip(batch.column(0), batch.column(1), strict=True):
                tree = _Tree(frozenset(skip))
                tree.feed(text.as_py() or "")
                tree.close()
                n = len(tree.rows)
                columns = list(zip(*tree.rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page.as_py()] * n, batch.column(0).type), pa.array(range(n), pa.int64()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                    [key, "element_no", "tag", "depth", "own_text"],
                )

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInArrow(parse, f"{key} {kind}, element_no bigint, tag string, depth bigint, own_text string")


#: Parsers by family: a function from pages to rows; further families are registered here.
PARSERS = {"elements": elements, "links": links, "findings": findings}


def parse(family: str, pages: DataFrame) -> DataFrame:
    if family not in PARSERS:
        raise ValueError(f"unknown parser family: {family}")
    return PARSERS[family](pages)


def table_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, row_no, cells of every table row with the text of its cells."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "row"))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    return rows.select(key, "row_no", F.transform(cells, strip_tags).alias("cells"))


def text_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = 20, first: int = 80) -> DataFrame:
    """key, block_no, text: paragraphs, items and headings of at least so many characters, the first ones of each page."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:p|li|h[1-6]|td|blockquote)\b[^>]*>(.*?)</(?:p|li|h[1-6]|td|blockquote)>"), F.lit(1))
    kept = F.slice(F.filter(F.transform(blocks, strip_tags), lambda x: F.length(x) >= least), 1, first)
    return pages.select(key, F.posexplode(kept).alias("block_no", "text"))


def label_counts(pages: DataFrame, labels: list[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """key, label, n of labels that a page's text has, not overlapping."""
    text = strip_tags(F.col(html))
    rows = pages.select(key, text.alias("_text"))
    count = lambda label: ((F.length("_text") - F.length(F.replace(F.col("_text"), F.lit(label), F.lit("")))) / len(label)).cast("bigint")
    each = F.array(*[F.struct(F.lit(label).alias("label"), count(label).alias("n")) for label in labels])
    return rows.select(key, F.inline(each)).where("n > 0")


def hidden_elements(html) -> Column:
    """Tags that a style or class hides."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<[a-z][^>]*(?:display\s*:\s*none|visibility\s*:\s*hidden|class="[^"]*\bhidden\b)[^>]*>"""), F.lit(0))


def crawl_order(found: DataFrame, key: str, url: str, position: str) -> DataFrame:
    """Each url of a page once, at its first position, with its ordinal from 1."""
    firsts = found.groupBy(key, url).agg(F.min(position).alias("position"))
    return firsts.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("position", url)))
