"""Goldens for functions and generators that the catalogue does not reach, and the reading and writing of files."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import find
from corpusloom.functions import text as tx
from corpusloom.operators import audit, entities, evaluation, linking, rag, sampling
from corpusloom.plans import questions
from corpusloom.sources import files, html
from corpusloom.streaming.occurrence_stream import windowed_counts


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values))
    return frame.select(column).first()[0]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, tx.normalize_text(t), t=" a b \r\n\n c\t d ") == "a b\nc d"
    assert one(spark, tx.normalize_multiline(t), t="\n a  b \n\n c​ \n") == "a b\n\nc"
    assert one(spark, tx.normalize_inline(t), t="é\n x") == "é x"
    assert one(spark, tx.search_tokens(t), t="_Ab_ c-d, தமிழ் 1") == ["ab", "c", "d", "தமிழ்", "1"]
    assert one(spark, tx.verse_tokens(t), t="Ab, cd! (ef)") == ["Ab", "cd", "ef"]
    assert one(spark, tx.tamil_ratio(t), t="தமab") == 0.5
    assert one(spark, tx.snippet(t, F.lit(50), F.lit(55)), t="x" * 200) == "..." + "x" * 89 + "..."
    assert one(spark, tx.compact_lines(t, 7), t="ab\n\ncd ef") == "ab / cd..."
    assert one(spark, tx.strip_suffix(t, ["ing", "s"]), t="walking") == "walk" and one(spark, tx.strip_suffix(t, ["ing", "s"]), t="sing") == "sing"
    assert one(spark, tx.split_phrase(t), t="a, b! c, d, e; f") == ["a, b", "c", "d", "e", "f"]
    assert one(spark, tx.char_ngrams(t), t="ab cd") == ["abc", "bcd"] and one(spark, tx.char_ngrams(t), t="ab") == ["ab"]
    assert one(spark, tx.containment(F.lit("a b"), t, F.array(F.lit("a"), F.lit("z"))), t="xa y") == 0.5
    assert one(spark, tx.stable_hash(t, F.lit(None)), t="x") == one(spark, tx.stable_hash(t, F.lit("None")), t="x")
    assert one(spark, tx.python_round(t, 2), t=0.125) == 0.12


def test_phrases():
    assert find.exact_span("ab, cd", "abcd") == (0, 6, "loose") and find.exact_span("xab", " ab, ") == (1, 3, "exact") and find.exact_span("", "a") is None
    assert find.word_span("x நிலவுடைய", "நிலவு") == (2, 7, "exact") and find.word_span("அவர் வீடுகளில்", "வீடுகள்") is None
    assert find.word_span("அ மலர்களை", "மலர்க") == (2, 7, "exact") and find.word_span("", "x") is None and find.clean_phrase(" “a  b” ") == "a b"
    assert find.parse_range("1,3-5", 6) == [1, 3, 4, 5]
    with pytest.raises(ValueError):
        find.parse_range("0-2", 5)


def test_titles_and_labels(spark):
    assert tuple(one(spark, find.split_title(F.col("t")), t="Place - a - b - Tune")) == ("Place", "a - b", "Tune")
    assert tuple(one(spark, find.split_labelled(F.col("t"), "Meaning", "Note"), t="Meaning: x y\nNote: z")) == ("x y", "z", "success")


def test_html(spark):
    page = '<html><head><title>A &amp; B</title></head><body><script>x("<p>no</p>")</script><p style="display: none">hid</p><table><tr><td>1</td><td><b>two</b></td></tr></table><p>A paragraph of some length here</p><a href="/x">go <i>on</i></a></body></html>'
    pages = spark.createDataFrame([(1, "http://h.org/a/b?c=1", page), (2, None, None), (3, "http://h.org/", "")], "page_id bigint, url string, html string")
    assert [tuple(r) for r in html.links(pages).collect()] == [(1, 0, "/x", "go on")]
    assert pages.select(html.title(F.col("html"))).first()[0] == "A & B"
    assert html.table_rows(pages).first().cells == ["1", "two"]
    assert [r.text for r in html.text_blocks(pages).collect()] == ["A paragraph of some length here"]
    assert len(pages.select(html.hidden_elements(F.col("html"))).first()[0]) == 1
    tags = [(r.tag, r.depth, r.own_text) for r in html.elements(pages).where("page_id = 1").orderBy("element_no").collect()]
    assert ("b", 5, "two") in tags and not any(t == "script" for t, *_ in tags)
    assert one(spark, html.resolve(F.lit("http://h.org/a/b?c"), F.col("t")), t="d") == "http://h.org/a/d"
    with pytest.raises(ValueError):
        html.parse("none", pages)


def test_files(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(path), "a int, b string").count() == 2
    assert files.read_optional(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    tables, issues = files.read_tables(spark, str(tmp_path), {"r": "a int", "missing": "a int"})
    assert tables["r"].count() == 2 and [i["key"] for i in issues] == ["missing"]
    rows = spark.createDataFrame([(1, "a|b|")], "n int, cell string")
    assert rows.select(files.split_cells(F.col("cell"))).first()[0] == ["a", "b"]
    assert files.write_once(rows, str(tmp_path / "once")) == "created" and files.write_once(rows, str(tmp_path / "once")) == "reused"
    with pytest.raises(FileExistsError):
        files.write_once(rows.withColumn("n", F.lit(2)), str(tmp_path / "once"))
    registry = tmp_path / "reg.json"
    registry.write_text(json.dumps({"registry_name": "syn", "records": [{"id": "1", "canonical": "a"}]}))
    assert files.read_registries(spark, [str(registry)]).first().registry_name == "syn"
    files.write_jsonl(rows, str(tmp_path / "out"))
    assert [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()] == [{"cell": "a|b|", "n": 1}]


def test_audits(spark):
    spans = spark.createDataFrame([("a", "s1", 0, 5), ("a", "s2", 3, 6), ("b", "s3", 0, 2)], "parent string, span_id string, start_char int, end_char int")
    assert [r.span_id for r in audit.overlapping_spans(spans, ["parent"]).collect()] == ["s2"]
    rows = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1")], "alias string, owner string")
    assert [r.alias for r in audit.many_owners(rows, "alias", "owner").collect()] == ["x"]
    assert one(spark, audit.score_from_penalties(F.col("t")), t=130.0) == 0


def test_entities(spark):
    text = spark.createDataFrame([(1, "red moon and moons"), (2, None)], "doc_id bigint, text string")
    lexicon = [("moon", "THING", "moon"), ("red moon", "THING", "red_moon")]
    assert sorted((r.term, r.start_char) for r in entities.mentions(text, "doc_id", lexicon).collect()) == [("moon", 4), ("red moon", 0)]
    pilot = entities.pilot_mentions(text, "doc_id", [("moon", "THING", "m"), ("moons", "THING", "m")])
    assert sorted((r.term, r.start_char) for r in pilot.collect()) == [("moon", 4), ("moons", 13)]


def test_linking(spark):
    records = spark.createDataFrame([("r", "red moon\nblue sun", "the red moon rises; a blue sun sets")], "record_id string, verse string, reply string")
    best = {r.line_no: r for r in linking.best_links(linking.candidate_features(records, "record_id", "verse", "reply"), "record_id", "line_no").collect()}
    assert best[1].target_text.startswith("the red moon") and best[2].target_text.endswith("blue sun sets") and best[1].candidate_count == 3
    links = spark.createDataFrame([("k", "a", "low", 0.9), ("k", "b", "high", 0.1)], "key string, link_id string, confidence string, score double")
    assert linking.dedupe(links, ["key"], "link_id").first().link_id == "b"


def test_context_budget(spark):
    results = spark.createDataFrame([(1, 1, "a", "a1"), (1, 2, "a", "a2"), (1, 3, "b", "b1"), (1, 4, "c", "c1"), (1, 5, "z", "z1")], "query_id int, rank int, record_id string, chunk_id string")
    records = spark.createDataFrame([("a", "12345", "67"), ("b", "abc", "defgh"), ("c", "x", "y")], "record_id string, f string, g string")
    got = rag.context_package(results, records, ["f", "g"], 5, 12).orderBy("rank").collect()
    assert [(r.context_id, r.record_id, r.f, r.g, r.content_char_count, r.content_truncated) for r in got] == [("ctx_001", "a", "12345", "67", 7, False), ("ctx_002", "b", "abc", "de", 5, True)]
    assert rag.package_errors(rag.context_package(results, records, ["f", "g"], 5, 12)).count() == 0


def test_samples_and_metrics(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(11)], "id int, g int")
    assert [r.id for r in sampling.spread_sample(rows.where("g = 0"), "id", 3, ["g"]).orderBy("id").collect()] == [0, 4, 10]
    assert sampling.hash_sample(rows, "id", 3).count() == 3 and sampling.first_per_group(rows, ["g"], ["id"], 2).count() == 4
    assert one(spark, evaluation.tier(F.col("t")), t=0.5) == "medium"
    raters = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (None, 1)], "a int, b int")
    assert evaluation.cohen_kappa(raters, "a", "b").first().kappa == pytest.approx(0.5)


def test_analytical_question(spark):
    index = spark.createDataFrame([("r1", "text", "red moon moon", "ann", "w", "s", "c", "k"), ("r2", "text", "lune", "bob", "w", "s", "c", "k")], "record_id string, field_name string, text string, author string, work string, source string, category_id string, corpus_id string")
    answer = questions.analytical("Which author mentions moon most", index, [("syn", [{"id": "1", "canonical": "moon", "related": ["lune"]}])])
    assert answer.intent == "group_by_author" and answer.term == "moon" and answer.terms == ["moon", "lune"]
    assert [(r.group_key, r.occurrence_count, r.percentage) for r in answer.groups.collect()] == [("ann", 2, 66.6667), ("bob", 1, 33.3333)]


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(500).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    batch = windowed_counts(spark.read.parquet(str(tmp_path / "in")), "ts", ["event_type"])
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_phrase_spans_equal_brute_force(spark):
    import re

    from corpusloom.plans.catalogue import QUERIES

    skipped = ",.;:!?-–—'\"“”‘’"
    found = {r.doc_id: (r.start_char, r.end_char, r.method) for r in QUERIES["phrase_spans"](spark, "/root/testdata/sf0.001").collect()}
    expected = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        clauses = re.findall(r"[^.!?।;,]+", r.text or "")
        phrase = find.clean_phrase(clauses[1]) if len(clauses) > 1 else ""
        if not phrase:
            continue
        if phrase in r.text:
            expected[r.doc_id] = (r.text.index(phrase), r.text.index(phrase) + len(phrase), "exact")
            continue
        places = [i for i, c in enumerate(r.text) if not c.isspace() and c not in skipped]
        at = "".join(r.text[i] for i in places).find("".join(phrase.split()))
        if at >= 0:
            expected[r.doc_id] = (places[at], places[at + len("".join(phrase.split())) - 1] + 1, "loose")
    assert found == expected and {m for *_, m in found.values()} == {"exact", "loose"}


def test_page_blocks_equal_brute_force(spark):
    import re

    from corpusloom.plans import more_catalogue

    got = sorted((r.page_id, r.block_no, r.text) for r in more_catalogue.page_blocks(spark, "/root/testdata/sf0.001").collect())
    expected = []
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        blocks = []
        for m in re.finditer(r"(?is)<(?:p|li|h[1-6]|td|blockquote)\b[^>]*>(.*?)</(?:p|li|h[1-6]|td|blockquote)>", r.html or ""):
            text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", m[1])
            text = re.sub(r"(?s)<[^>]*>", " ", text)
            for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
                text = text.replace(entity, char)
            text = re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")
            blocks += [text] if len(text) >= 20 else []
        expected += [(r.page_id, n, t) for n, t in enumerate(blocks[:80])]
    assert got == sorted(expected)


def test_alignment_equals_all_choices():
    import itertools
    import random

    from corpusloom.operators import alignment

    rng = random.Random(5)
    for _ in range(150):
        lines = [[(f := rng.randint(1, 5), f + rng.randint(0, 1), round(rng.random(), 3)) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]

        def total(path, reverse, lines=lines):
            out = lines[0][path[0]][2]
            for a, b, i, k in zip(lines, lines[1:], path, path[1:], strict=False):
                step = alignment.transition(a[i][:2], b[k][:2], reverse)
                if step is None:
                    return None
                out += b[k][2] + step
            return out

        for reverse in (False, True):
            best = max((t for p in itertools.product(*map(lambda x: range(len(x)), lines)) if (t := total(p, reverse)) is not None), default=None)
            path = alignment.monotone_path(lines, reverse)
            assert best is None or total(path, reverse) == pytest.approx(best)
        free = [sum(x[2] for x in c) for c in itertools.product(*lines) if all(a[1] < b[0] or b[1] < a[0] for a, b in itertools.combinations(c, 2))]
        chosen = alignment.assignment(lines)
        assert (chosen is None) == (not free) and (chosen is None or sum(line[k][2] for line, k in zip(lines, chosen, strict=True)) == pytest.approx(max(free)))


def test_character_path_equals_all_choices(spark):
    import itertools
    import random

    import numpy as np

    from corpusloom.operators import alignment

    def step(a, b, reverse):
        if a[:2] == b[:2]:
            return -0.16
        gap = a[0] - b[1] if reverse else b[0] - a[1]
        return -0.30 if gap < 0 else 0.10 if gap <= 3 else 0.06 if gap <= 80 else 0.02

    rng = random.Random(6)
    for _ in range(150):
        lines = [[(float(s := rng.randint(0, 120)), float(s + rng.randint(1, 20)), round(rng.random(), 3)) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 4))]
        for reverse in (False, True):
            totals = {p: sum(line[k][2] for line, k in zip(lines, p, strict=True)) + sum(step(a[i], b[k], reverse) + 0.03 for a, b, i, k in zip(lines, lines[1:], p, p[1:], strict=False)) for p in itertools.product(*map(lambda x: range(len(x)), lines))}
            path, score = alignment.character_path([np.array(x) for x in lines], reverse)
            assert totals[tuple(path)] == pytest.approx(max(totals.values())) and score == pytest.approx(max(totals.values()) / len(lines), abs=1e-4)
    rows = [(1, 1, 0, 10, 0.5, "x"), (1, 1, 50, 60, 0.45, "x"), (1, 2, 12, 20, 0.4, "x"), (1, 2, 0, 10, 0.45, "x"), (1, 3, 22, 30, 0.5, "y"), (2, 1, 0, 5, 0.2, "x")]
    got = {(r.group, r.line_no): r for r in alignment.assigned(spark.createDataFrame(rows, "group long, line_no long, start long, end long, score double, family string")).collect()}
    assert [got[1, n].start for n in (1, 2, 3)] == [0, 12, 22] and got[1, 2].method == "global_forward" and got[2, 1].margin == got[2, 1].score == pytest.approx(0.2 + 0.05 + 0.03)
    assert alignment.character_path([]) == ([], 0.0)


def test_median_equals_sorted_values(spark):
    import random
    import statistics

    from corpusloom.operators import reports

    rng = random.Random(9)
    for n in (1, 2, 7, 400, 401):
        values = [rng.choice([rng.randint(0, 9), rng.randint(0, 10**6), -5]) for _ in range(n)]
        r = reports.score_summary(spark.createDataFrame([(v,) for v in [*values, None]], "v bigint"), "v").first()
        assert (r.n, r.low, r.high, r.median) == (n, min(values), max(values), statistics.median(values)) and r["mean"] == pytest.approx(statistics.mean(values))
    assert reports.score_summary(spark.createDataFrame([], "v bigint"), "v").first().n == 0
