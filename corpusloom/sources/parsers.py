"""Parsers of record families: pages to records of one shape, for verse, dictionaries, grammar rules, prose and what has no parser of its own.

A parser is a function from a page's tree and address to records (dictionaries). `records` runs one over a table of pages
in Arrow batches; a page without records of the family has no rows. What differs between sites, such as works and path
fragments, is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import parse_qs, parse_qsl, urljoin, urlparse

from pyspark.sql import DataFrame

from corpusloom.functions.generate import generated
from corpusloom.sources.dom import Node, clean, tree

SCHEMA_VERSION = "website-corpus-v2"
#: What links to a commentary are called, how their targets are written, and the labels of its parts; fixed values
COMMENTARY_WORD = "உரை"
OPENED = re.compile(r"window\.open\('([^']+)'")
FIRST_LABEL = re.compile(r"(?:\d+\.\s*)?(?:பொழிப்புரை|பொ-ரை)\s*[:;]")
SECOND_LABEL = re.compile(r"(?:குறிப்புரை|கு-ரை)\s*[:;]")
SONG_NUMBER = re.compile(r"பாடல்\s+எண்\s*:?\s*(\d+)")
HEADING, RULE_NO = re.compile(r"^(\d+)\s*\.\s*(.+)$"), re.compile(r"^(\d+)\.?$")
COLOPHON_BREAKS = (".-", ".–", " - ", "–")
HEADWORDS = frozenset({"சொல்", "தலைச்சொல்", "headword"})
DEFINITIONS = frozenset({"அருஞ்சொற்பொருள்", "பொருள்", "definition"})
PARTS_OF_SPEECH = frozenset({"சொல்வகை", "இலக்கணக்குறிப்பு", "part of speech", "pos"})
#: Columns of a record, and those that a family may add
COLUMNS = (
    "record_id", "record_type", "title", "author", "genre", "section_id", "chapter_id", "content_text", "commentary_text", "source_url", "commentary_url", "source_record_id", "parser_family",
)
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", details map<string, string>"


@dataclass(frozen=True)
class Context:
    """What a whole run says of its records: category, book, work and pilot, defaults of a source, and the prefix of ids."""

    category_id: str
    book_id: str = ""
    work_id: str = ""
    pilot_id: str = ""
    prefix: str = "rec"
    source: dict[str, str] = field(default_factory=dict)


def record_key(context: Context, native: str, url: str, content: str) -> str:
    """An id that depends on category, book, work, native id, address and content only."""
    identity = json.dumps([context.category_id, context.book_id, context.work_id, native, url, content], ensure_ascii=False, separators=(",", ":"))
    return f"{context.prefix}_{context.category_id}_{hashlib.sha256(identity.encode()).hexdigest()[:20]}"


def mapped(values: dict[str, str], context: Context, family: str, kind: str) -> dict[str, str]:
    """One unit's values as a record: content from text, verse, definition or title, commentary from its parts, an id from what identifies it."""
    v = {k: clean(x) for k, x in {**context.source, **values}.items()}
    first = lambda *names: next((v[n] for n in names if v.get(n)), "")
    content = first("content_text", "verse_text", "definition", "title")
    commentary = v.get("commentary_text") or " ".join(x for x in (v.get("pozhppurai"), v.get("kurippurai")) if x)
    url = first("source_url", "hymn_url")
    native = first("record_id", "source_record_id", "song_no", "entry_headword")
    out = {c: v.get(c, "") for c in COLUMNS} | {"record_id": record_key(context, native, url, content), "record_type": v.get("record_type") or kind, "content_text": content, "commentary_text": commentary, "source_url": url, "parser_family": family}
    return out | {"source_record_id": v.get("record_id", "") or v.get("source_record_id", ""), "details": {k: x for k, x in v.items() if k not in COLUMNS and x}}


def split_colophon(value: str) -> tuple[str, str]:
    """Situation and author of a colophon, at the last of the first break that it has."""
    whole = clean(value)
    for mark in COLOPHON_BREAKS:
        if mark in whole:
            left, right = whole.rsplit(mark, 1)
            return clean(left), clean(right)
    return whole, ""


def _commentary_link(node: Node) -> Node | None:
    return next((a for a in node.all("a") if clean(a.text()) == COMMENTARY_WORD), None)


def verse(page: Node, url: str, work: str = "verse") -> Iterator[dict[str, str]]:
    """Poems under numbered headings: lines in `poem`, a link to the commentary, and a colophon after the footer."""
    for heading in page.all("div", "subhead"):
        found, table = HEADING.match(clean(heading.text())), heading.above("table")
        body = table.next("table") if found and table else None
        if body is None:
            continue
        lines = [x for d in body.all("div", "poem") if (x := clean(d.text()))]
        if not lines:
            continue
        link, footer = _commentary_link(body), body.next("div", "footer")
        after = footer.next("table") if footer else None
        poem = after.first("div", "poem") if after else None
        colophon = clean(poem.text()) if poem else ""
        situation, author = split_colophon(colophon)
        number, setting = found[1], clean(found[2])
        yield {
            "record_id": f"{work}:{number}", "title": f"{work} {number}. {setting}", "author": author, "poem_no": number, "song_no": number, "verse_no": number, "thinai": setting, "thurai": situation, "colophon": colophon,
            "verse_text": "\n".join(lines), "content_text": "\n".join(lines), "source_url": url, "commentary_url": urljoin(url, link.attrs.get("href", "")) if link else "",
        }


def _column(headers: list[str], labels: frozenset[str]) -> int | None:
    known = {x.casefold() for x in labels}
    return next((i for i, h in enumerate(headers) if h.casefold() in known), None)


def dictionary(page: Node, url: str, work: str = "entry") -> Iterator[dict[str, str]]:
    """Rows of tables that have a column of headwords and one of definitions."""
    for table in page.all("table"):
        rows = [[clean(c.text()) for c in row.all() if c.tag in ("td", "th")] for row in table.all("tr")]
        if not rows:
            continue
        head, meaning, part = (_column(rows[0], labels) for labels in (HEADWORDS, DEFINITIONS, PARTS_OF_SPEECH))
        if head is None or meaning is None:
            continue
        for number, cells in enumerate(rows[1:], 1):
            if max(head, meaning) < len(cells) and cells[head] and cells[meaning]:
                speech = cells[part] if part is not None and part < len(cells) else ""
                yield {
                    "record_id": f"{work}:{number}:{cells[head]}", "title": cells[head], "entry_headword": cells[head], "definition": cells[meaning], "part_of_speech": speech, "content_text": cells[meaning], "source_url": url,
                    "part_of_speech_source": "explicit" if speech else "not_provided",
                }


def grammar(page: Node, url: str, work: str = "rule") -> Iterator[dict[str, str]]:
    """Numbered rows whose second cell is a `poem`: a rule and the address of its commentary."""
    for row in page.all("tr"):
        cells = row.own("td")
        found = RULE_NO.match(clean(cells[0].text())) if len(cells) > 1 else None
        if not found or "poem" not in cells[1].classes():
            continue
        text = "\n".join(x for line in cells[1].text("\n").splitlines() if (x := clean(line)))
        if text:
            link = _commentary_link(row)
            target = re.search(r"['\"]([^'\"]+\?[^'\"]+)['\"]", link.attrs.get("onclick", "")) if link else None
            yield {"record_id": f"{work}:{found[1]}", "title": f"{work} {found[1]}", "rule_no": found[1], "rule_text": text, "content_text": text, "source_url": url, "commentary_url": urljoin(url, target[1]) if target else ""}


def prose(page: Node, url: str, work: str = "") -> Iterator[dict[str, str]]:
    """Paragraphs of marked sections, numbered within their section."""
    link = parse_qs(urlparse(url).query).get("linkid", [""])[0]
    for section in (n for n in page.below() if "data-prose-section" in n.attrs or "prose-section" in n.classes()):
        head = next((n for n in section.below() if "data-section-title" in n.attrs or "section-title" in n.classes() or n.tag in ("h1", "h2", "h3")), None)
        title, name = clean(head.text()) if head else "", clean(section.attrs.get("data-section-id") or link)
        marked = (n for n in section.all("p") if "data-prose-paragraph" in n.attrs or "prose-paragraph" in n.classes())
        for number, text in enumerate((x for n in marked if (x := clean(n.text()))), 1):
            place = f"{name}:p{number:03d}"
            yield {"record_id": place, "title": title, "section_id": place, "content_text": text, "source_url": url, "paragraph_index": str(number), "section_source_id": name, "source_work": work}


def whole_page(page: Node, url: str, work: str = "") -> Iterator[dict[str, str]]:
    """The page as one record, for families without a parser of their own."""
    title, text = page.first("title"), page.text()
    if text:
        yield {"record_id": url, "title": clean(title.text()) if title else "", "content_text": text, "source_url": url}


#: Record type and parser of each family; further families are registered here
FAMILIES: dict[str, tuple[str, Callable[..., Iterator[dict[str, str]]]]] = {
    "verse_parser": ("verse", verse), "prose_parser": ("prose_section", prose), "grammar_parser": ("grammar_rule", grammar), "dictionary_parser": ("dictionary_entry", dictionary),
    "table_parser": ("dictionary_entry", whole_page), "image_metadata_parser": ("manuscript_image", whole_page), "mixed_parser": ("prose_section", whole_page), "external_link_registry": ("external_reference", whole_page),
}


def records(pages: DataFrame, family: str, context: Context, work: str | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key and the columns of SCHEMA for every record of a family that a page holds."""
    if family not in FAMILIES:
        raise ValueError(f"unsupported parser family: {family}")
    kind, parser = FAMILIES[family]

    def make():
        def find(address, text):
            page = tree(text)
            for values in parser(page, address or "", *([work] if work is not None else [])):
                record = mapped(values, context, family, kind)
                yield (*(record[c] for c in COLUMNS), list(record["details"].items()))

        return find

    return generated(pages, [key], [url, html], SCHEMA, make)


# --- poem pages ----------------------------------------------------------------------------------------------------------


def _opened(url: str, row: Node) -> str:
    """The address that a row's link to its commentary opens."""
    link = next((a for a in row.all("a") if COMMENTARY_WORD in "".join(a.strings())), None) or next((a for a in row.all("a") if "onclick" in a.attrs), None)
    found = OPENED.search(link.attrs.get("onclick", "")) if link else None
    return urljoin(url, found[1]) if found else ""


def poem_source(cell: Node) -> Node:
    """Where a poem's text is: the second cell of its inner row, its table, its nested cell, or itself."""
    row = cell.first("tr")
    cells = row.own("td") if row else []
    if len(cells) > 1 and cells[1].first("table", "tamil") is None:
        return cells[1]
    return cell.first("table", "tamil") or cell.first("td", "poem") or cell


def _line(node: Node) -> str:
    return " ".join(node.text().split())


def visible_number(cell: Node, outer: Node | None, source: Node) -> str:
    """A poem's number as the page shows it: in its inner row, in the row's number cell, by a label, in a number cell within, or as its first word."""
    row = cell.first("tr")
    cells = row.own("td") if row else []
    if len(cells) > 1 and (value := _line(cells[0]).rstrip(".")):
        return value
    if outer is not None and any(c is cell for c in outer.own("td")):
        before = outer.own("td")
        before = before[: next(i for i, c in enumerate(before) if c is cell)]
        number = next((c for c in reversed(before) if "pno" in c.classes()), None)
        if number is not None and (value := _line(number).rstrip(".")):
            return value
    if found := SONG_NUMBER.search(cell.text()):
        return found[1]
    if (own := cell.first("td", "pn")) is not None:
        return _line(own).rstrip(".")
    nested = next((c for c in cell.all("td", "pno") if "".join(c.strings()).isdigit()), None)
    return _line(nested).rstrip(".") if nested is not None else _line(source).split(" ", 1)[0].rstrip(".")


def poems(pages: DataFrame, corpus: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, paadal_id, song_no, local_song_no, verse_index, paadal_text, commentary_url of every poem of a page; a number that a page repeats gets its place."""

    def make():
        def find(address, text):
            page, seen, count = tree(text), set(), 0
            for cell in page.all("td", "poem"):
                if cell.above("td", "poem") is not None:
                    continue
                outer, source = cell.above("tr"), poem_source(cell)
                number = visible_number(cell, outer, source)
                body = "\n".join(x for line in source.text("\n").splitlines() if (x := " ".join(line.split())))
                if not number or not body:
                    continue
                link = _opened(address or "", outer) if outer is not None else ""
                song = dict(parse_qsl(urlparse(link).query, keep_blank_values=True)).get("song_no", number)
                name = f"{corpus}_paadal_{song}"
                if name in seen:
                    sub = dict(parse_qsl(urlparse(address or "").query, keep_blank_values=True)).get("subid", "")
                    song = f"{song}_{sub}_{count + 1}"
                    name = f"{corpus}_paadal_{song}"
                seen.add(name)
                count += 1
                yield name, song, number, count, body, link

        return find

    return generated(pages, [key], [url, html], "paadal_id string, song_no string, local_song_no string, verse_index bigint, paadal_text string, commentary_url string", make)


def hymn_title(page: Node) -> str:
    head = next((n for n in page.below() if "subhead" in n.classes()), None)
    return _line(head) if head is not None else ""


def hymns(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, hymn_title, song_no, verse_number, verse_text, commentary_url, book_id, head_id, sub_id of verses in rows of number, text and verse number."""

    def make():
        def find(address, text):
            page = tree(text)
            title = hymn_title(page)
            for cell in page.all("td", "poem"):
                row = cell.first("tr")
                cells = row.own("td") if row else []
                if len(cells) < 2:
                    continue
                lines = [x for line in cells[1].text("\n").splitlines() if (x := " ".join(line.split()))]
                outer = cell.above("tr")
                link = _opened(address or "", outer) if outer is not None else ""
                asked = dict(parse_qsl(urlparse(link).query, keep_blank_values=True))
                song = asked.get("song_no", _line(cells[0]).rstrip("."))
                if song and lines:
                    yield title, song, _line(cells[-1]), "\n".join(lines), link, asked.get("book_id", ""), asked.get("head_id", ""), asked.get("sub_id", asked.get("subid", ""))

        return find

    return generated(pages, [key], [url, html], "hymn_title string, song_no string, verse_number string, verse_text string, commentary_url string, book_id string, head_id string, sub_id string", make)


def commentaries(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pozhppurai, kurippurai, extraction_status, warnings (by comma) of every page of commentary, by its two labels."""

    def make():
        def find(text):
            whole = "\n".join(x for line in tree(text).text("\n").splitlines() if (x := " ".join(line.split())))
            a, b = FIRST_LABEL.search(whole), SECOND_LABEL.search(whole)
            first = whole[a.end() : b.start() if b else len(whole)].strip() if a else ""
            second = whole[b.end() :].strip() if b else ""
            warnings = [n for n, found in (("missing_pozhppurai", a), ("missing_kurippurai", b)) if not found]
            yield first, second, "success" if first and second else "partial_commentary", ",".join(warnings)

        return find

    return generated(pages, [key], [html], "pozhppurai string, kurippurai string, extraction_status string, warnings string", make)


def index_links(pages: DataFrame, fragment: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, ordinal, subid, title, target of links whose address has the fragment and a subid, each address once; frame pages have none."""

    def make():
        def find(address, text):
            page, seen = tree(text), set()
            if page.first("frame") is not None or page.first("iframe") is not None:
                return
            for a in page.all("a"):
                target = urljoin(address or "", a.attrs["href"]) if "href" in a.attrs else ""
                sub = dict(parse_qsl(urlparse(target).query, keep_blank_values=True)).get("subid", "")
                if fragment in target and sub and target not in seen:
                    seen.add(target)
                    yield len(seen), sub, _line(a), target

        return find

    return generated(pages, [key], [url, html], "ordinal bigint, subid string, title string, target string", make)


def is_internal(url: str, host: str) -> bool:
    """Whether an address is relative or of the host."""
    return urlparse(url).netloc in {"", host}
