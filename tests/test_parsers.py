"""Page trees and record parsers on small pages, and fetching with a function of our own."""

import hashlib
import json

import pytest

from corpusloom.operators import normalized
from corpusloom.sources import fetch, parsers
from corpusloom.sources.dom import tree

VERSE = """<table><tr><td><div class="subhead">12. குறிஞ்சி</div></td></tr></table>
<table><tr><td><div class="poem">line one</div><div class="poem"> line <b>two</b></div><div class="poem"> </div><a href="c.jsp?x=1">உரை</a></td></tr></table>
<div class="footer">f</div><table><tr><td><div class="poem">a situation.- an author</div></td></tr></table>
<table><tr><td><div class="subhead">no number</div></td></tr></table><table><tr><td><div class="poem">x</div></td></tr></table>"""
WORDS = "<table><tr><th>சொல்</th><th>பொருள்</th><th>POS</th></tr><tr><td>மதி</td><td>moon</td><td>noun</td></tr><tr><td>x</td><td></td></tr><tr><td>விடை</td><td>bull</td></tr></table><table><tr><td>a</td></tr></table>"
RULES = """<table><tr><td>1.</td><td class="poem">rule<br>text</td><td><a onclick="window.open('l.jsp?a=2','w')">உரை</a></td></tr><tr><td>x</td><td class="poem">no</td></tr><tr><td>2</td><td>plain</td></tr></table>"""
PROSE = '<div class="prose-section" data-section-id="s1"><h2>Title</h2><p class="prose-paragraph">First <i>one</i></p><p>not</p><p data-prose-paragraph>Second</p></div>'
POEM = """<table><tr><td class="pno">7.</td><td class="poem"><table class="tamil"><tr><td>1</td><td>first line<br>second</td><td>9</td></tr></table></td><td><a onclick="window.open('u.jsp?song_no=77&amp;book_id=5','w')">உரை</a></td></tr>
<tr><td class="poem"><table class="tamil"><tr><td>1</td><td>other</td><td>9</td></tr></table></td><td><a onclick="window.open('u.jsp?song_no=77','w')">உரை</a></td></tr><tr><td class="poem"> </td></tr></table>"""


def pages(spark, *html, url="http://h.org/p.jsp?subid=3&linkid=L"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], "page_id bigint, url string, html string").withColumnRenamed("title", "title")


def records(spark, family, *html, **options):
    out = parsers.records(pages(spark, *html), family, parsers.Context("cat", "b", "w", "p"), **options)
    return sorted(out.collect(), key=lambda r: (r.page_id, r.source_record_id))


def test_tree_closes_what_it_must():
    page = tree("<p>a<p>b<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table><script>if (a<b) {}</script><img src=x>tail")
    assert [n.text() for n in page.all("p")] == ["a", "b"] and [n.text() for n in page.all("li")] == ["x", "y"]
    assert [[c.text() for c in r.own("td")] for r in page.all("tr")] == [["1", "2"], ["3"]] and page.text().endswith("3 tail")
    assert tree(None).text() == "" and tree("<b" * 50).text() is not None
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert tree(deep).text() == "x"


def test_verse(spark):
    (r,) = records(spark, "verse_parser", VERSE, "", None, work="w")
    assert (r.source_record_id, r.title, r.author, r.content_text) == ("w:12", "w 12. குறிஞ்சி", "an author", "line one\nline two")
    assert r.details["thurai"] == "a situation" and r.commentary_url == "http://h.org/c.jsp?x=1" and r.record_type == "verse"
    identity = json.dumps(["cat", "b", "w", "w:12", "http://h.org/p.jsp?subid=3&linkid=L", r.content_text], ensure_ascii=False, separators=(",", ":"))
    assert r.record_id == f"rec_cat_{hashlib.sha256(identity.encode()).hexdigest()[:20]}"
    assert parsers.split_colophon("no break") == ("no break", "") and parsers.split_colophon("a – b – c") == ("a – b", "c")


def test_dictionary_grammar_prose(spark):
    got = records(spark, "dictionary_parser", WORDS)
    assert [(r.title, r.content_text, r.details.get("part_of_speech"), r.details["part_of_speech_source"]) for r in got] == [("மதி", "moon", "noun", "explicit"), ("விடை", "bull", None, "not_provided")]
    (rule,) = records(spark, "grammar_parser", RULES, work="g")
    assert (rule.source_record_id, rule.content_text, rule.commentary_url, rule.record_type) == ("g:1", "rule\ntext", "http://h.org/l.jsp?a=2", "grammar_rule")
    got = records(spark, "prose_parser", PROSE, PROSE.replace(' data-section-id="s1"', ""))
    assert [(r.page_id, r.section_id, r.title, r.content_text) for r in got] == [(0, "s1:p001", "Title", "First one"), (0, "s1:p002", "Title", "Second"), (1, "L:p001", "Title", "First one"), (1, "L:p002", "Title", "Second")]
    (whole,) = records(spark, "mixed_parser", "<title>T</title><p>x</p>", "")
    assert (whole.title, whole.content_text, whole.record_type) == ("T", "T x", "prose_section")
    with pytest.raises(ValueError):
        parsers.records(pages(spark, ""), "none", parsers.Context("c"))


def test_poem_pages(spark):
    got = sorted(parsers.poems(pages(spark, POEM, None), "c1").collect(), key=lambda r: r.verse_index)
    assert [(r.paadal_id, r.local_song_no, r.paadal_text) for r in got] == [("c1_paadal_77", "1", "first line\nsecond"), ("c1_paadal_77_3_2", "1", "other")]
    assert got[0].commentary_url == "http://h.org/u.jsp?song_no=77&book_id=5"
    hymns = sorted(parsers.hymns(pages(spark, '<div class="subhead">A  hymn</div>' + POEM)).collect(), key=lambda r: r.verse_text)
    assert [(r.hymn_title, r.song_no, r.verse_number, r.book_id) for r in hymns] == [("A hymn", "77", "9", "5"), ("A hymn", "77", "9", "")]
    (c, d) = sorted(parsers.commentaries(pages(spark, "<p>பொழிப்புரை : one<br>two</p><p>குறிப்புரை: note</p>", "<p>x</p>")).collect(), key=lambda r: r.page_id)
    assert (c.pozhppurai, c.kurippurai, c.extraction_status, c.warnings) == ("one\ntwo", "note", "success", "")
    assert (d.extraction_status, d.warnings) == ("partial_commentary", "missing_pozhppurai,missing_kurippurai")
    index = '<a href="son.jsp?subid=1"> a - b - c</a><a href="son.jsp?subid=1">again</a><a href="son.jsp">no</a><a href="x.jsp?subid=2">no</a>'
    assert [(r.ordinal, r.subid, r.title) for r in parsers.index_links(pages(spark, index, f"<iframe src=x></iframe>{index}"), "son.jsp").collect()] == [(1, "1", "a - b - c")]
    assert parsers.is_internal("/a", "h.org") and parsers.is_internal("http://h.org/a", "h.org") and not parsers.is_internal("http://x.org", "h.org")


def test_fetching(spark):
    def own(url, timeout):
        if "bad" in url:
            raise OSError("no")
        return f"<p>{url}</p>"

    wanted = spark.createDataFrame([("u1", None), ("bad2", ["u2"]), ("bad3", ["bad4"]), ("old", None)], "url string, fallbacks array<string>")
    pages, failures = fetch.read_or_fetched(wanted, spark.createDataFrame([("old", "stored")], "url string, html string"), fetch=own)
    assert {(r.url, r.html, r.origin) for r in pages.collect()} == {("u1", "<p>u1</p>", "fetched"), ("bad2", "<p>u2</p>", "fetched"), ("old", "stored", "snapshot")}
    (lost,) = failures.collect()
    assert lost.url == "bad3" and "bad4: OSError: no" in lost.error
    rows = spark.createDataFrame([("a", "p1", "u"), ("a", None, "bad3"), ("b", None, "w")], "corpus_id string, paadal_id string, url string")
    assert [r.url for r in fetch.selected_failures(rows, ["a"], "thogupu").collect()] == ["bad3"] and fetch.selected_failures(rows).count() == 3


def test_normalised_records(spark):
    rows = spark.createDataFrame([("An", "7", "2", " v ", None, None), ("B", "8", "3", "w", "wn ", "own")], "author string, hymn_id string, song_no string, verse_text string, verse_text_normalized string, record_id string")
    got = {r.song_no: r for r in normalized.unified(rows, normalized.Corpus("c2", 2, "Second", aliases={"An": "Ann"}, prefix="k")).collect()}
    assert (got["2"].record_id, got["2"].author, got["2"].verse_text, got["2"].verse_id) == ("k_02_7_2", "Ann", "v", "k_02_7_2_verse") and (got["3"].record_id, got["3"].verse_text) == ("own", "wn")
    assert got["2"].citation_text == "Ann, Second, , 2."
    rows = spark.createDataFrame(
        [("dictionary_entry", "d", " def ", "c", None, None), ("verse", "sangam_literature", None, "c", " v ", None), ("rule", "grammar", None, "c", None, " r "), ("x", "twentieth_century_prose", None, " c ", None, None)],
        "record_type string, category_id string, definition string, content_text string, verse_text string, rule_text string",
    )
    got = {r.category_id: r for r in normalized.by_category(rows).collect()}
    assert (got["d"].content_text, got["sangam_literature"].content_text, got["grammar"].content_text, got["twentieth_century_prose"].record_type) == ("def", "v", "r", "prose_section")
    assert got["grammar"].rule_no == "" and got["d"].language == "ta"
    table = spark.createDataFrame([(" a\n\n b  c ", " x \n y")], "paadal_text string, title string")
    row = normalized.table_row(table, "paadalgal", ("title",)).first()
    assert (row.paadal_text, row.title, row.tokenized_paadal) == ("a\n\nb c", "x y", ["a", "b", "c"])
    assert normalized.newline_count(table, "paadal_text", "title").first().newlines == 3
