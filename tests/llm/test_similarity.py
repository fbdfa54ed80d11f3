"""The similarity of near-duplicates: op1's contract of 85 percent, and the stage's 80 percent."""

import random

import numpy as np

import corpus_pipeline
from corpusloom.llm import near_dedup

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def changed(words, count, mark):
    words = list(words)
    for k in range(count):
        words[10 + 20 * k] = f"{mark}{k}"
    return " ".join(words)


def test_the_stage_drops_from_80_percent_on(spark):
    rows = []
    for family, (count, seed) in enumerate([(5, 1), (6, 2), (6, 3), (7, 4), (2, 5)]):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        rows += [(10 * family, " ".join(words)), (10 * family + 1, changed(words, count, f"x{family}_"))]
    sets = {d: shingle_set(t) for d, t in rows}
    close = {p: {d + 1 for d in range(0, 50, 10) if 100 * len(sets[d] & sets[d + 1]) >= p * len(sets[d] | sets[d + 1])} for p in (80, 85)}
    assert close == {80: {1, 11, 21, 41}, 85: {41}}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert left == set(sets) - close[80]
    assert {r.doc_id for r in near_dedup.near_duplicates(docs).where("not kept").collect()} == close[85]


def test_the_stage_drops_pairs_of_the_table_between_80_and_85_percent(spark):
    pairs = [(1, 255), (709, 944), (582, 875), (643, 770)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id in {tuple(d for p in pairs for d in p)}")
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    assert all(80 * len(sets[a] | sets[b]) <= 100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b]) for a, b in pairs)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {a for a, _ in pairs}


def test_radii_follow_the_similarity():
    assert near_dedup.limits_at(85) == near_dedup.Limits(85, near_dedup.RADIUS, 125)
    stage = near_dedup.limits_at(near_dedup.STAGE_PERCENT)
    rng = np.random.default_rng(7)
    assert (rng.binomial(near_dedup.SYMBOLS, 0.2, 400_000) > stage.radius).sum() <= 8
    assert (rng.binomial(near_dedup.FINE, 0.1, 400_000) > stage.fine_radius).sum() <= 2
    chunks = rng.binomial(near_dedup.CHUNK, 0.2, (400_000, near_dedup.CHUNKS))
    assert (chunks.min(axis=1) > 1).sum() <= 2


def exact_components(sets, percent):
    """Smallest index of each set's component, by a join on the rarest shingles that any pair at the similarity must share one of."""
    count = {}
    for s in sets:
        for x in s:
            count[x] = count.get(x, 0) + 1
    parent, seen = list(range(len(sets))), {}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        own = sorted(sets[i], key=lambda x: (count[x], x))
        near = set()
        for x in own[: len(own) - (percent * len(own) + 99) // 100 + 1]:
            near.update(seen.get(x, ()))
            seen.setdefault(x, []).append(i)
        for j in near:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(sets))]


def test_components_equal_those_of_an_exact_join(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    for percent in (80, 85):
        expected = {rows[i][0]: rows[t][0] for i, t in enumerate(exact_components(sets, percent))}
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, percent).collect()} == expected


def test_a_family_below_the_similarity_makes_no_rows_of_its_pairs(spark, monkeypatch):
    rng = random.Random(11)
    base, texts = [f"w{rng.randrange(10**9)}" for _ in range(800)], []
    for copy in range(150):
        words = list(base)
        for k in rng.sample(range(5, 795, 10), 8):
            words[k] = f"x{copy}_{k}"
        texts.append(words)
    for copy in range(0, 150, 10):
        texts.append([*texts[copy][:200], f"y{copy}", *texts[copy][201:]])
    sets = [shingle_set(" ".join(t)) for t in texts]
    expected = exact_components(sets, 85)
    assert len(set(expected)) > 60 and sum(100 * len(a & b) < 85 * len(a | b) for i, a in enumerate(sets) for b in sets[:i]) > 10_000
    looked_at, confirm = [], near_dedup.confirm
    monkeypatch.setattr(near_dedup, "confirm", lambda documents, classes, pairs, percent: looked_at.append(pairs.count()) or confirm(documents, classes, pairs, percent))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    for side, block in ((64, 1024), (16, 48)):
        monkeypatch.setattr(near_dedup, "SIDE", side, raising=False)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
        lowest = {}
        for i, top in enumerate(expected):
            lowest[top] = min(lowest.get(top, i), i)
        assert got == {i: lowest[top] for i, top in enumerate(expected)}
    assert max(looked_at) < 10 * len(texts)


def test_overlaps_of_sorted_sets():
    sets = [np.sort(np.random.default_rng(k).choice(60, 5 + 4 * k, replace=False).astype(np.uint64)) for k in range(8)]
    first = np.cumsum([0, *map(len, sets)])
    to = np.array([6, 0, 3, 7])
    assert near_dedup.overlaps(np.concatenate(sets), first, 5, to).tolist() == [len({*sets[5]} & {*sets[k]}) for k in to]
