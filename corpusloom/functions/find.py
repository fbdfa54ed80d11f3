"""Where a phrase stands in a text: exactly, but for white space and punctuation, or with a case ending."""

from __future__ import annotations

import re
import unicodedata

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.generate import generated

#: What a phrase loses at its ends, marks that may follow it, endings that a word may take, and how much longer a word may be; fixed values
OUTER = " \t\r\n,.;:!?-–—'\"“”‘’"
MARKS = (",", ".", "!", ";", ":", "?", "।")
CASE_ENDINGS = ("ஐ", "ை", "இன்", "உடைய", "து", "தை", "னை", "ரை", "னது", "னுடைய", "ரும்")
WORD_SLACK = 8
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("method", T.StringType())])
_SKIPPED = frozenset(",.;:!?-–—'\"“”‘’")
_TAMIL_WORD = re.compile(r"[\u0b80-\u0bff]+")


def clean_phrase(phrase: str) -> str:
    """NFC on one line without outer punctuation."""
    return " ".join(unicodedata.normalize("NFC", phrase or "").split()).strip(OUTER)


def _dense(text: str) -> tuple[str, list[int]]:
    """text without white space and light punctuation, and where each character stood."""
    places = [i for i, c in enumerate(text) if not c.isspace() and c not in _SKIPPED]
    return "".join([text[i] for i in places]), places


def exact_span(text: str, phrase: str) -> tuple[int, int, str] | None:
    """The first place of a cleaned phrase: as it is, else without regard to white space and light punctuation between its characters."""
    phrase = clean_phrase(phrase)
    if not text or not phrase:
        return None
    if (at := text.find(phrase)) >= 0:
        return at, at + len(phrase), "exact"
    wanted = "".join(phrase.split())
    dense, places = _dense(text)
    at = dense.find(wanted)
    return (places[at], places[at + len(wanted) - 1] + 1, "loose") if at >= 0 else None


def word_span(text: str, phrase: str) -> tuple[int, int, str] | None:
    """exact_span, else the phrase with one of the endings, else the first Tamil word that begins with it and is little longer."""
    if found := exact_span(text, phrase):
        return found
    base = clean_phrase(phrase)
    if not text or not base:
        return None
    for ending in CASE_ENDINGS:
        if found := exact_span(text, base + ending):
            return found[0], found[1], "case_ending"
    short = "".join(base.split())
    words = (m for m in _TAMIL_WORD.finditer(text) if m[0].startswith(short) and len(m[0]) <= len(short) + WORD_SLACK)
    return next(((m.start(), m.end(), "prefix") for m in words), None)


def contained(rows: DataFrame, key: str, phrases: list[tuple], text: str = "text") -> DataFrame:
    """key, phrase_id of every phrase (id, text) that a text holds: one pass of an automaton of all phrases over whole texts."""

    def make():
        automaton, by_text = ahocorasick.Automaton(), {}
        for name, phrase in phrases:
            if phrase:
                by_text.setdefault(phrase, []).append(name)
        for phrase, names in by_text.items():
            automaton.add_word(phrase, names)
        if by_text:
            automaton.make_automaton()

        def find(text):
            held = {id(names): names for _, names in automaton.iter(text)} if by_text and text else {}
            return [(name,) for names in held.values() for name in names]

        return find

    kind = "string" if any(isinstance(name, str) for name, _ in phrases) else "bigint"
    return generated(rows, [key], [text], f"phrase_id {kind}", make)


def _frame(found: list[tuple[int, int, str] | None]) -> pd.DataFrame:
    starts, ends, methods = zip(*(f or (None, None, None) for f in found), strict=True) if found else ((), (), ())
    return pd.DataFrame({"start": pd.array(starts, "Int32"), "end": pd.array(ends, "Int32"), "method": pd.Series(methods, dtype=object)})


@F.pandas_udf(SPAN)
def find_exact(text: pd.Series, phrase: pd.Series) -> pd.DataFrame:
    return _frame([exact_span(t, p) for t, p in zip(text, phrase, strict=True)])


@F.pandas_udf(SPAN)
def find_word(text: pd.Series, phrase: pd.Series) -> pd.DataFrame:
    return _frame([word_span(t, p) for t, p in zip(text, phrase, strict=True)])


def parse_range(text: str, most: int) -> list[int]:
    """Sorted numbers of `1,3-5`, each from 1 to most."""
    out: set[int] = set()
    for part in text.split(","):
        low, _, high = part.strip().partition("-")
        out |= set(range(int(low), int(high or low) + 1))
    if not out or min(out) < 1 or max(out) > most:
        raise ValueError(f"range must lie within 1 and {most}: {text}")
    return sorted(out)


def split_title(title: Column) -> Column:
    """struct(place, note, tune) of `place - note - tune`; what is between the first and the last part is the note."""
    parts = F.filter(F.transform(F.split(title, r"\s+-\s+", -1), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(parts)
    return F.struct(
        F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("place"),
        F.when(n > 2, F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), " - ")).otherwise("").alias("note"),
        F.when(n > 1, F.get(parts, n - 1)).otherwise("").alias("tune"),
    )


def split_labelled(text: Column, first: str, second: str) -> Column:
    """struct(first, second, status) of a text with two labels (patterns): what follows each, and whether both are there."""
    a = F.regexp_extract(text, rf"(?s)(?:{first})\s*[:：-]*\s*(.*?)(?:(?:{second})|$)", 1)
    b = F.regexp_extract(text, rf"(?s)(?:{second})\s*[:：-]*\s*(.*)$", 1)
    a, b = (F.regexp_replace(x, r"^\s+|\s+$", "") for x in (a, b))
    status = F.when((a != "") & (b != ""), "success").when((a != "") | (b != ""), "partial_commentary").otherwise("no_commentary")
    return F.struct(a.alias("first"), b.alias("second"), status.alias("status"))
