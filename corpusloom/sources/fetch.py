"""Pages from addresses: a snapshot where there is one, else a fetch, with fallback addresses and what failed as rows.

Fetching is a function from (url, timeout) to text, so that tests and closed networks bring their own. Snapshots are a table
(url, html); fetched pages are appended to it by the caller with `html.snapshot_name` or as Parquet.
"""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.generate import generated


def fetch_html(url: str, timeout: float = 30.0) -> str:
    """The body of a page as text, by its declared encoding or UTF-8."""
    request = urllib.request.Request(url, headers={"User-Agent": "corpusloom"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def fetched(wanted: DataFrame, fetch: Callable[[str, float], str] = fetch_html, timeout: float = 30.0, delay: float = 0.0) -> DataFrame:
    """url, html, fetched_url, error of every wanted row (url, fallbacks array or null): the first address that answers, else the errors.

    Addresses are asked one after the other within a task, with delay seconds between them; repartition to ask more at once.
    """

    def make():
        def find(url, fallbacks):
            errors = []
            for n, address in enumerate([url, *(fallbacks or [])]):
                if n or delay:
                    time.sleep(delay)
                try:
                    yield fetch(address, timeout), address, None
                    return
                except Exception as e:  # noqa: BLE001  a page that fails is a row, not the end of the run
                    errors.append(f"{address}: {type(e).__name__}: {e}")
            yield None, None, "; ".join(errors)

        return find

    return generated(wanted, ["url"], ["url", "fallbacks"], "html string, fetched_url string, error string", make)


def read_or_fetched(wanted: DataFrame, snapshots: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(pages, failures): url, html, origin of pages by snapshot or fetch, and url, error of those that neither gave."""
    stored = snapshots.select("url", "html").dropDuplicates(["url"])
    read = wanted.select("url").join(stored, "url").withColumn("origin", F.lit("snapshot"))
    new = fetched(wanted.join(stored.select("url"), "url", "left_anti"), **options)
    pages = read.unionByName(new.where("error is null").select("url", "html", F.lit("fetched").alias("origin")))
    return pages, new.where("error is not null").select("url", "error")


def selected_failures(failures: DataFrame, corpora: list[str] | None = None, kind: str = "all") -> DataFrame:
    """Failures of some corpora and of one kind: commentary where a passage is named, else thogupu."""
    is_kind = F.when(F.col("paadal_id").isNotNull(), "commentary").otherwise("thogupu")
    rows = failures.where(F.col("corpus_id").isin(*corpora)) if corpora else failures
    return rows if kind == "all" else rows.where(is_kind == kind)


def missing_again(failures: DataFrame, pages: DataFrame) -> DataFrame:
    """Failures whose page is still not there: what a later run has to fetch."""
    return failures.join(pages.select("url"), "url", "left_anti")
