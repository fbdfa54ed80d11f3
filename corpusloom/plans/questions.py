"""Composed entries: an analytical question to grouped statistics, and a question to cited context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from corpusloom.operators import occurrences, rag, retrieval

@dataclass(frozen=True)
class Answer:
    intent: str
    term: str
    terms: list[str]
    group_by: str
    groups: DataFrame
    statistics: DataFrame
    evidence: DataFrame


def should_expand(question: str, term: str, expansion: dict) -> bool:
    """Whether the question asks for related terms, or the registries have any for its term."""
    return any(w in retrieval.plain(question) for w in retrieval.EXPANSION_HINTS) or bool(term) and expansion["applied"]


def registered_terms(registries: list) -> list[str]:
    """All terms of the registries, the longest first."""
    known = {t for _, records in registries for r in records for t in (r["canonical"], *r.get("related", []))}
    return sorted(known, key=lambda t: (-len(t), t))


def analytical(question: str, index: DataFrame, registries: list, top_n: int = 10, samples: int = 5) -> Answer:
    """Intent, target term, its expansion, and the term's occurrences grouped by what the question names; nothing for an unsupported one."""
    asked = retrieval.classify_query(question, registered_terms(registries))
    term = asked["term"]
    expansion = retrieval.expand(term, registries)
    supported = asked["intent"] != "unsupported"
    terms = expansion["expanded_terms"] if should_expand(question, term, expansion) and expansion["expanded_terms"] else [term]
    group_by = asked["group_by"] if asked["group_by"] in occurrences.GROUP_KEYS else "author"
    found = occurrences.search(index, terms if supported else [])
    evidence = found.orderBy("deterministic_key").limit(samples)
    return Answer(asked["intent"], term, terms if supported else [], group_by, occurrences.group(found, group_by, top_n), occurrences.statistics(found), evidence)


def cited_context(results: DataFrame, records: DataFrame, fields: list[str], source: list[str], top_k: int = 5, max_chars: int = 6000) -> tuple[DataFrame, DataFrame]:
    """Context packages of ranked results and their citations."""
    contexts = rag.context_package(results, records, fields, top_k, max_chars)
    return contexts, rag.citations(contexts.join(records.select("record_id", *source), "record_id"), source)
