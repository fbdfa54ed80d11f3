"""Release, enriched and index records: projections with fallbacks, citations, identifiers and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def alias_of(column: Column, aliases: dict[str, str]) -> Column:
    """The canonical name of a value; itself where it has none."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    return column if table is None else F.coalesce(F.try_element_at(table, column), column)


def citation_text(*parts: Column) -> Column:
    """Present parts joined by commas."""
    return F.concat_ws(", ", *map(tx.missing, parts))


def enriched(records: DataFrame, verse: str, first: str, second: str, title: str, author: str, group: str, number: str) -> DataFrame:
    """A record's id, normalised fields, search text, tokens, citation and filter metadata.

    first and second are its two commentaries; group and number, texts of numbers, give its id and its rank key.
    """
    texts = {k: tx.normalize_text(F.coalesce(F.col(c), F.lit("")), compose=False) for k, c in (("verse", verse), ("pozhppurai", first), ("kurippurai", second), ("hymn_title", title), ("author", author))}
    rows = records.select("*", *[v.alias(f"_{k}") for k, v in texts.items()])
    t = {k: F.col(f"_{k}") for k in texts}
    metadata = F.concat_ws(" ", *[tx.missing(x) for x in (t["hymn_title"], t["author"], F.col(group), F.col(number))])
    whole = F.concat_ws("\n\n", *[tx.missing(t[k]) for k in ("verse", "pozhppurai", "kurippurai")], tx.missing(metadata))
    status = F.when((t["pozhppurai"] != "") & (t["kurippurai"] != ""), "success").when((t["pozhppurai"] != "") | (t["kurippurai"] != ""), "partial_commentary").otherwise("no_commentary")
    return rows.select(
        F.concat_ws("_", F.lit("record"), F.col(group), F.col(number)).alias("record_id"), F.col(group).alias("hymn_id"), F.col(number).alias("song_no"),
        *[v.alias(k) for k, v in t.items()], metadata.alias("metadata"), whole.alias("search_text"), tx.search_tokens(whole).alias("tokens"),
        tx.unique_terms(tx.search_tokens(whole)).alias("unique_terms"), citation_text(t["author"], t["hymn_title"], F.col(number)).alias("citation_text"),
        status.alias("extraction_status"), (status != "no_commentary").alias("commentary_available"), tx.rank_key(F.expr(f"try_cast({group} as int)"), F.expr(f"try_cast({number} as int)")).alias("rank_key"),
    )


def text_statistics(verse: Column, *commentaries: Column) -> Column:
    """struct of characters and non-blank lines of a verse, lengths of its commentaries and Tamil characters."""
    lines = F.size(F.filter(F.split(verse, "\n", -1), lambda x: F.trim(x) != ""))
    return F.struct(
        F.length(verse).alias("verse_chars"), lines.alias("verse_lines"), *[F.length(c).alias(f"commentary_{i}_chars") for i, c in enumerate(commentaries, 1)],
        F.regexp_count(verse, F.lit(f"[{tx.TAMIL}]")).alias("tamil_chars"),
    )


def contract(rows: DataFrame, key: str, required: dict[str, str]) -> DataFrame:
    """key, field, problem: fields that are missing, blank or not of the type that the contract names."""
    kinds = dict(rows.dtypes)
    each = []
    for field, kind in required.items():
        if field not in kinds:
            each.append(F.struct(F.lit(field).alias("field"), F.lit("absent").alias("problem")))
            continue
        value = F.col(field)
        blank = value.isNull() | (F.trim(value.cast("string")) == "") if kinds[field] in ("string", "int", "bigint", "double", "boolean") else value.isNull()
        wrong = F.expr(f"try_cast(`{field}` as {kind})").isNull() if kinds[field] == "string" and kind != "string" else F.lit(kinds[field] != kind and kinds[field] != "string")
        each.append(F.when(blank, F.struct(F.lit(field).alias("field"), F.lit("missing").alias("problem"))).when(wrong, F.struct(F.lit(field).alias("field"), F.lit("wrong_type").alias("problem"))))
    return rows.select(F.col(key).cast("string").alias("key"), F.inline(F.array_compact(F.array(*each))))


def citation_problems(rows: DataFrame, key: str, required: list[str], rank: str, url: str) -> DataFrame:
    """key, problems: required fields that are blank, ranks below 1 and urls of no known shape."""
    problems = F.array_compact(
        F.array(*[F.when(tx.missing(F.col(c).cast("string")).isNull(), f"missing {c}") for c in required], F.when(F.col(rank) < 1, "rank"), F.when(~tx.valid_url(F.col(url)), "url"))
    )
    return rows.select(key, problems.alias("problems")).where(F.size("problems") > 0)


def digest_of(rows: DataFrame) -> Column:
    """An aggregate that names a table's rows whatever their order, repeated ones too."""
    return F.coalesce(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows, checksum of tables; the checksum does not depend on the order of rows."""
    out = None
    for name, rows in tables.items():
        own = rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), digest_of(rows).alias("checksum"))
        out = own if out is None else out.unionByName(own)
    return out


def merged_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """The entries of both, the new ones' winning."""
    a, b = old.select("name", F.col("rows").alias("old_rows"), F.col("checksum").alias("old_sum")), new.select("name", F.col("rows").alias("new_rows"), F.col("checksum").alias("new_sum"))
    return a.join(b, "name", "full_outer").select("name", F.coalesce("new_rows", "old_rows").alias("rows"), F.coalesce("new_sum", "old_sum").alias("checksum"))
