"""Scalar text expressions: normalisers, tokenizers, identifiers, windows of context, similarities and quality flags.

All of these are Column expressions that stay in the JVM, but for `nfc`, for which Spark has no built-in.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The Tamil block, whose combining marks no word class covers; a superset keeps other scripts' results the same.
TAMIL = r"\x{0B80}-\x{0BFF}"
TOKEN_BREAK = rf"[^\p{{L}}\p{{N}}_{TAMIL}]+"
#: Punctuation that ends a verse token; fixed values
VERSE_BREAK = r"[\s.,;:!?\"'()\[\]{}|/\\\-–—…“”‘’।॥]+"
ZERO_WIDTH = "​‌‍﻿"
SNIPPET_RADIUS, CONTEXT_RADIUS = 42, 24


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def strip(column) -> Column:
    """column without outer white space of any kind."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def missing(column) -> Column:
    """null where a text is null or blank, as blank is how the data model says missing."""
    return F.nullif(strip(column), F.lit(""))


def first_present(*columns) -> Column:
    """The first text that is not missing, else an empty one."""
    return F.coalesce(*map(missing, columns), F.lit(""))


def normalize_text(text, compose: bool = True) -> Column:
    """NFC, one kind of line break, plain spaces, single spaces within lines, no empty lines."""
    text = F.regexp_replace(F.regexp_replace(nfc(text) if compose else text, "\r\n?", "\n"), " ", " ")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[ \t\x0B\f]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalize_inline(text, compose: bool = True) -> Column:
    """normalize_text on one line."""
    return F.trim(F.regexp_replace(normalize_text(text, compose), r"(?U)\s+", " "))


def normalize_multiline(text, compose: bool = True) -> Column:
    """Single spaces within lines; inner blank lines stay, outer ones go."""
    text = F.regexp_replace(canonical_characters(text, compose), "\r\n?", "\n")
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[ \t\x0B\f]+", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def canonical_characters(text, compose: bool = True) -> Column:
    """NFC without zero-width characters and with plain spaces."""
    return F.translate(F.translate(nfc(text) if compose else text, ZERO_WIDTH, ""), " ", " ")


def normalize_map(column, compose: bool = False) -> Column:
    """A map with normalised keys and values."""
    values = F.transform_values(column, lambda _, v: normalize_inline(v, compose))
    return F.transform_keys(values, lambda k, _: normalize_inline(k, compose))


def normalize_list(column, compose: bool = False) -> Column:
    """An array of normalised texts without empty ones."""
    return F.filter(F.transform(column, lambda x: normalize_inline(x, compose)), lambda x: x != "")


def strip_labels(text, labels: str) -> Column:
    """text without labels (a pattern) at its start."""
    return F.trim(F.regexp_replace(text, rf"^(?:{labels})\s*[:：-]*\s*", ""))


def search_tokens(text) -> Column:
    """Lower-cased tokens of letters, digits and marks without outer underscores."""
    tokens = F.transform(F.split(F.lower(text), TOKEN_BREAK, -1), lambda x: F.btrim(x, F.lit("_")))
    return F.filter(tokens, lambda x: x != "")


def longest_inner_token(phrase) -> Column:
    """The longest search token that any text which holds phrase has too, or null: one between two breaks inside of phrase.

    What stands at an end of phrase may be part of a longer token there, and the lower case of a sigma depends on what follows.
    """
    pieces = F.split(F.lower(phrase), TOKEN_BREAK, -1)
    inner = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda x: F.btrim(x, F.lit("_")))
    whole = F.filter(inner, lambda x: (x != "") & ~x.rlike("[σς]"))
    return F.array_max(F.transform(whole, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]


def verse_tokens(text) -> Column:
    """Tokens between punctuation, case kept."""
    return F.filter(F.split(text, VERSE_BREAK, -1), lambda x: x != "")


def unique_terms(tokens) -> Column:
    return F.array_sort(F.array_distinct(tokens))


def token_estimate(tokens) -> Column:
    return F.greatest(F.lit(1), F.size(tokens))


def tamil_ratio(text) -> Column:
    """Tamil letters to all letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(rf"[\p{{L}}&&[{TAMIL}]]")) / letters).otherwise(0.0)


def tamil_share(text) -> Column:
    """Characters of the Tamil block to all that aren't spaces."""
    chars = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.when(chars > 0, F.regexp_count(text, F.lit(f"[{TAMIL}]")) / chars).otherwise(0.0)


def stable_id(*parts) -> Column:
    """Lower-cased slugs of the parts, empty ones skipped, joined by `_`."""
    slugs = [F.nullif(F.btrim(F.regexp_replace(F.lower(p), rf"[^\p{{L}}\p{{N}}{TAMIL}]+", "_"), F.lit("_")), F.lit("")) for p in parts]
    return F.concat_ws("_", *slugs)


def stable_hash(*parts, length: int = 16) -> Column:
    """First hex digits of the SHA-256 of parts joined by `|`; a null is `None`."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, length)


def rank_key(first, second, kind=None) -> Column:
    """Zero-padded key that sorts as its numbers do."""
    key = F.format_string("%04d:%04d", first.cast("int"), second.cast("int"))
    return key if kind is None else F.concat_ws(":", key, kind)


def window_of(text, start, end, radius: int = CONTEXT_RADIUS) -> Column:
    """The characters within radius of the 0-based half-open span."""
    left = F.greatest(F.lit(0), start - radius)
    right = F.least(F.length(text), end + radius)
    return F.substring(text, left + 1, right - left)


def snippet(text, start, end, radius: int = SNIPPET_RADIUS) -> Column:
    """Keyword in context, with `...` where the text goes on."""
    before = F.when(start - radius > 0, "...").otherwise("")
    after = F.when(end + radius < F.length(text), "...").otherwise("")
    return F.concat(before, F.trim(window_of(text, start, end, radius)), after)


def compact_lines(text, limit: int) -> Column:
    """Lines joined by ` / `, cut to the limit with `...`."""
    joined = F.array_join(F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), " / ")
    return F.when(F.length(joined) > limit, F.concat(F.rtrim(F.substring(joined, 1, limit)), F.lit("..."))).otherwise(joined)


def compact(text) -> Column:
    """text without white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def char_ngrams(text, n: int = 3) -> Column:
    """Distinct n-grams of the compact text; the whole of it where it isn't longer than n."""
    c = compact(text)
    grams = F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    return F.when(c == "", F.array().cast("array<string>")).when(F.length(c) <= n, F.array(c)).otherwise(grams)


def _joined(n: int):
    return lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(n)])


def word_ngrams(tokens, most: int = 3) -> Column:
    """All word n-grams from one to `most` words, in order of length and place."""
    # Shifted copies are zipped, as a lambda that looked tokens up again would evaluate them at every step.
    grams = [tokens]
    for n in range(2, most + 1):
        shifted = F.arrays_zip(*[F.slice(tokens, k + 1, F.greatest(F.size(tokens), F.lit(1))).alias(f"w{k}") for k in range(n)])
        grams.append(F.slice(F.transform(shifted, _joined(n)), 1, F.greatest(F.size(tokens) - n + 1, F.lit(0))))
    return F.concat(*grams)


def jaccard(a, b) -> Column:
    """Set similarity, 0 where either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(source, target, tokens) -> Column:
    """1 if the compact source is in the compact target, else the share of the source's tokens in it."""
    held = F.size(F.filter(tokens, lambda x: F.contains(target, x)))
    return F.when((F.length(source) > 0) & F.contains(compact(target), compact(source)), 1.0).when(F.size(tokens) == 0, 0.0).otherwise(held / F.size(tokens))


def strip_suffix(token, suffixes: list[str], stem: int = 2) -> Column:
    """token without the first of the suffixes that leaves more than `stem` characters."""
    out = token
    for suffix in reversed(suffixes):
        short = F.substring(token, F.lit(1), F.length(token) - len(suffix))
        out = F.when(token.endswith(suffix) & (F.length(token) - len(suffix) > stem), short).otherwise(out)
    return out


def split_phrase(text) -> Column:
    """Parts at `!?;`, and at commas where there are three or more."""
    parts = F.split(text, r"[!?;]+", -1)
    split = F.transform(parts, lambda p: F.when(F.size(F.split(p, ",", -1)) >= 3, F.split(p, ",", -1)).otherwise(F.array(p)))
    return F.filter(F.transform(F.flatten(split), lambda x: F.trim(x)), lambda x: x != "")


def is_numbering(text) -> Column:
    """A line that is only a number."""
    return F.trim(text).rlike(r"^[0-9०-९௦-௯]+[.)]?$")


def numeric_only(tokens) -> Column:
    return (F.size(tokens) > 0) & F.forall(tokens, lambda x: x.rlike(r"^[0-9௦-௯]+$"))


def cue_present(text, expression: str) -> Column:
    """Whether text holds a cue expression `a|b + c`: all groups, of each at least one alternative."""
    held = F.lit(True)
    for group in expression.split("+"):
        alternatives = [a.strip() for a in group.split("|") if a.strip()]
        own = F.lit(False)
        for a in alternatives:
            own = own | F.contains(text, F.lit(a))
        held = held & own if alternatives else held
    return held


#: Single tokens that say nothing, digits and words for numbers that make a text numeric; fixed values
GENERIC_TOKENS = frozenset("உடைய என் தன் தம் நம் அது இது அவன் இவன் அவர் இவர் ஆக ஆகிய என என்று என்னும்".split())
NUMBER_WORDS = frozenset("பூஜ்யம் சுழியம் ஒன்று ஒரு ஓர் இரண்டு மூன்று நான்கு ஐந்து ஆறு ஏழு எட்டு ஒன்பது பத்து பதினொன்று பன்னிரண்டு பதின்மூன்று பதினான்கு பதினைந்து பதினாறு பதினேழு பதினெட்டு பத்தொன்பது இருபது".split())


QUALITY_PUNCTUATION = r"""^[\s,.;:!?()\[\]{}"'“”‘’\-–—/\\|]+$"""


def tamil_characters(text) -> Column:
    return F.regexp_count(text, F.lit(f"[{TAMIL}]"))


def text_quality(text, allow_single: bool = True, script=tamil_characters) -> Column:
    """struct(status, flags, token_count, script_chars, normalized): keep or reject by the first rule that holds, and mild flags of what is kept.

    script counts the characters of the corpus's script; texts with fewer than two of them are rejected.
    """
    normalized = F.trim(F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))
    tokens, letters = F.regexp_extract_all(normalized, F.lit(rf"[{TAMIL}0-9A-Za-z]+"), F.lit(0)), script(normalized)
    one = F.get(tokens, F.lit(0))
    number = F.forall(tokens, lambda x: x.rlike(r"^[0-9௦-௯]+$") | x.isin(*NUMBER_WORDS))
    why = (
        F.when(normalized == "", "empty").when(normalized.rlike(QUALITY_PUNCTUATION), "punctuation_only").when((F.size(tokens) > 0) & number, "numeric_only")
        .when(letters == 0, "no_tamil_text").when(letters < 2, "too_few_tamil_chars").when((F.size(tokens) == 1) & one.isin(*GENERIC_TOKENS), "generic_single_token")
    )
    if not allow_single:
        why = F.coalesce(why, F.when(F.size(tokens) == 1, "single_token_not_allowed"))
    mild = F.when(F.size(tokens) == 1, "short_but_valid_single_token").when(F.size(tokens) <= 2, "very_short_span").otherwise("clean")
    return F.struct(
        F.when(why.isNull(), "keep").otherwise("reject").alias("status"), F.array(F.coalesce(why, mild)).alias("flags"),
        F.size(tokens).cast("bigint").alias("token_count"), letters.cast("bigint").alias("script_chars"), normalized.alias("normalized"),
    )


def query_map(url) -> Column:
    """Query parameters of a url."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&", -1), lambda x: x != "")
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")))
    return F.map_from_entries(F.array_distinct(entries))


def valid_url(url) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/?#\s]+"), F.lit(False))


def python_round(x, digits: int) -> Column:
    """Rounding half to even, as reports have it."""
    return F.bround(x, digits)
