"""MinHash near-dedup by a multi-index Hamming join.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Each set gets a signature of SYMBOLS b-bit MinHash
symbols. Two signatures differing in at most RADIUS symbols agree, by pigeonhole, in some chunk of CHUNK symbols but for
at most one symbol; enumerating that one allowed error gives CHUNK keys a chunk, and two rows meet in a key if and only if
such a chunk exists. All pairs within RADIUS thus meet. At similarity 0.85 a symbol differs with probability 0.15, so
a pair lies beyond 17 of 36 with a probability of about 9e-7. A lower similarity has a larger radius (`limits_at`), again
passed with at most LOST; between RADIUS and that one the keys are no longer certain, but a pair at 0.80 has no such chunk
with a probability of about 2e-7 only.

Equal sets are one class before anything is joined, so that exact copies cost one row. Of the pairs that meet within the
radius, those already in one component need no look, as they can't change the result; the others are held against a
longer sketch of single bits, which a pair at the similarity passes but for a probability of FINE_LOST, and confirmed on
full sets. A group of near copies is first linked to the extreme members of its key buckets; after that only pairs that
are still in different components are compared, in blocks of bounded size. Blocks of keys hand on spanning forests of the
pairs within both radii, which join classes into families; all pairs of a family are then held against each other in blocks
that have the full sets, and hand on spanning forests of the links. So neither pairs of a group nor a group itself is ever
gathered or written anywhere. Components come from spanning forests of bounded parts of the edges, with large-star/small-star
rounds over what is left where one part does not hold it.

Nulls and texts without words have an empty set and link with nothing. A null doc_id orders after all others. Repeated
rows are rows of their own in one class. Only `doc_id` and `text` are read, so further columns can have any name. An empty
table has no result rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.generate import bounded_batches
from corpusloom.llm.common import BROADCAST_BYTES, SPACE_FREE, by_size, checkpointed, mix, semi_by_size, text_slices, word_hashes, word_spans

WIDTH = 5
CHUNKS, CHUNK = 9, 4
SYMBOLS = CHUNKS * CHUNK
RADIUS = 2 * CHUNKS - 1
#: The similarity of op1's contract, and that of a stage that isn't told another.
PERCENT, STAGE_PERCENT = 85, 80
BLOCK = 1024
#: A family is dealt into parts of SIDE rows, but into SIDES parts at most while these have no more than BLOCK rows and SIDE_BYTES.
SIDE, SIDES, SIDE_BYTES = 64, 32, 4 << 20
#: Edges of which one task makes a spanning forest: 8 MB.
EDGES_A_TASK = 1 << 19
#: A second, longer sketch of single bits, for pairs within the radius only: a bit differs with half the probability of a symbol.
FINE = 1024
#: Products of a set's members and hash functions that are held at once: 2 MB.
PRODUCTS = 1 << 18
#: Most bytes of shingle sets that are broadcast to the pairs.
SET_BYTES = BROADCAST_BYTES // 2
#: Bytes that a small row takes in a broadcast table.
ROW_BYTES = 192
#: Most probability with which a pair at the similarity may lie beyond the radius (or have no key), and beyond the fine radius.
LOST, FINE_LOST = 2.5e-6, 7e-8

_RNG = np.random.RandomState(20240611)
_A = (_RNG.randint(0, 1 << 62, SYMBOLS + FINE, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.randint(0, 1 << 62, SYMBOLS + FINE, dtype=np.int64).astype(np.uint64)
_PLACE = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


@dataclass(frozen=True)
class Limits:
    """A similarity in percent, and in how many symbols and fine bits a pair of that similarity may differ."""

    percent: int
    radius: int
    fine_radius: int

    def sizes(self, a, b):
        """Whether sets of such sizes can reach the similarity."""
        return (100 * a >= self.percent * b) & (100 * b >= self.percent * a)


def _beyond(n: int, chance: float, most: float) -> int:
    """Least r such that more than r of n independent events of that chance happen with a probability of most at most."""
    tail = 0.0
    for k in range(n, 0, -1):
        tail += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(chance) + (n - k) * math.log1p(-chance))
        if tail > most:
            return k
    return 0


def limits_at(percent: int) -> Limits:
    """The radii of a similarity; below some 75 percent the keys are too few."""
    apart = 1 - percent / 100
    if not 0 < apart < 1:
        raise ValueError("percent must lie between 0 and 100")
    no_key = (1 - (1 - apart) ** CHUNK - CHUNK * apart * (1 - apart) ** (CHUNK - 1)) ** CHUNKS
    if no_key > LOST:
        raise ValueError(f"at {percent} percent a pair has no key in common with a probability of {no_key:.1g}: more chunks are needed")
    return Limits(percent, _beyond(SYMBOLS, apart, LOST), _beyond(FINE, apart / 2, FINE_LOST))


def shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's set: sorted distinct 64-bit hashes of 5-word shingles, or of all its words where there are fewer."""
    for i, j, data, offsets in text_slices(column):
        starts, ends, first = word_spans(data, offsets, SPACE_FREE)
        words = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        count = max(0, len(words) - WIDTH + 1)
        rolled = np.zeros(count, np.uint64)
        for k in range(WIDTH if count else 0):
            rolled += words[k : k + count] * _PLACE[k]
        rolled = mix(rolled)
        for row in range(j - i):
            lo, hi = first[row], first[row + 1]
            if hi - lo >= WIDTH:
                yield np.unique(rolled[lo : hi - WIDTH + 1])
            elif hi > lo:
                yield mix(np.array([np.sum(words[lo:hi] * _PLACE[: hi - lo])], np.uint64) + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


def digest(values: np.ndarray) -> bytes:
    """16 bytes that name a set: two wrapping sums of its mixed members, with its size."""
    n = np.uint64(len(values))
    one = np.sum(mix(values ^ np.uint64(0x1B873593CC9E2D51)), dtype=np.uint64) + n
    two = np.sum(mix(values ^ np.uint64(0x52DCE729DA3E39CB)), dtype=np.uint64) ^ n
    return np.array([one, two], np.uint64).tobytes()


def minima(values: np.ndarray, which: slice) -> np.ndarray:
    """Mixed minima of some of the hash functions over a set."""
    scale, shift = _A[which, None], _B[which, None]
    low = np.full(len(scale), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, PRODUCTS // len(scale))
    for at in range(0, len(values), step):
        part = values[None, at : at + step] * scale
        part += shift
        np.minimum(low, part.min(axis=1), out=low)
    return mix(low)


def signature(values: np.ndarray) -> bytes:
    """SYMBOLS 16-bit MinHash symbols."""
    return (minima(values, slice(SYMBOLS)) >> np.uint64(48)).astype(np.uint16).tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, classes, signatures = [], [], []
        for values in shingles(batch.column(1)):
            sizes.append(len(values))
            classes.append(digest(values))
            signatures.append(signature(values) if len(values) else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())],
            ["doc_id", "n_shingles", "class", "signature"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        classes, sets, held = [], [], 0
        for values in shingles(batch.column(0)):
            classes.append(digest(values))
            sets.append(values.view(np.int64))
            held += len(values)
            if held > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["class", "set"])
                classes, sets, held = [], [], 0
        if classes:
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["class", "set"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        classes, sketches = [], []
        for values in shingles(batch.column(0)):
            classes.append(digest(values))
            sketches.append(np.packbits((minima(values, slice(SYMBOLS, None)) >> np.uint64(63)).astype(bool)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(sketches, pa.binary())], ["class", "fine"])


def _near(limits: Limits, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, to, n, n_to, signature, signature_to) those that can reach the similarity, with their distance in symbols."""
    for batch in batches:
        n, n_to = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        differ = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint16) != np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint16)
        distance = differ.reshape(-1, SYMBOLS).sum(axis=1)
        near = pa.array(limits.sizes(n, n_to) & (distance <= limits.radius))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance.astype(np.int32))], ["node", "to", "distance"]).filter(near)


def chunk_keys(signature_column) -> F.Column:
    """The CHUNKS * CHUNK keys of a signature: each chunk with each one of its symbols left out."""
    keys = []
    for c in range(CHUNKS):
        for j in range(CHUNK):
            start = c * CHUNK * 2
            left = F.substring(signature_column, start + 1, 2 * j)
            right = F.substring(signature_column, start + 2 * j + 3, 2 * (CHUNK - 1 - j))
            keys.append(F.xxhash64(F.lit(c * CHUNK + j), left, right))
    return F.array(*keys)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all ends of edges: roots are hooked to smaller ones until every edge lies within one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _forest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as (node, root) of forests of at most `most` edges at a time, merged while they fit."""
    held, size = [np.zeros((2, 0), np.int64)], 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        size += len(batch)
        if size >= most:
            held = [np.stack(forest(*np.concatenate(held, axis=1)))]
            size = held[0].shape[1]
            if size >= most:
                yield _edges(held[0])
                held, size = [np.zeros((2, 0), np.int64)], 0
    yield _edges(np.stack(forest(*np.concatenate(held, axis=1))))


def _edges(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def connected(edges: DataFrame, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """(node, component) of the ends of edges (a, b), component being the smallest node.

    Tasks make spanning forests of what they hold, so that at most one edge a node and task is left. Once all edges fit one
    task its forest is the result; until then large-star and small-star rounds go over them.
    """
    made = partial(_forest, most=2 * edges_a_task)
    edges = checkpointed(edges.select("a", "b").mapInArrow(made, "a bigint, b bigint"))
    while True:
        rows = edges.count()
        if rows <= edges_a_task:
            return edges.coalesce(1).mapInArrow(made, "node bigint, component bigint")
        edges = edges.coalesce(1 + rows // edges_a_task).mapInArrow(made, "a bigint, b bigint").where("a <> b")
        both = checkpointed(edges).select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        edges = checkpointed(small.where("a <> b").distinct())
        rows, nodes = edges.agg(F.count("*"), F.count_distinct("a")).first()
        if rows == nodes and edges.join(edges.select(F.col("b").alias("top")), F.col("a") == F.col("top"), "left_semi").isEmpty():
            return edges.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("component")).distinct()


def _blocks(find):
    """A function over rows sorted by (key, i, j) that calls find for tables of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            group = np.stack([table[c].to_numpy() for c in ("key", "i", "j")])
            cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            if last:
                yield from find(table.slice(0, last), np.concatenate([[0], cuts]))
            rest = table.slice(last)
        if rest is not None and len(rest):
            yield from find(rest, np.array([0, len(rest)]))

    return run


def _forests(limits: Limits, table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each group's minimum spanning forest by sketch distance (Prim), but for edges within a component: no more pairs than rows."""
    node, component, n = (table[c].to_numpy() for c in ("node", "component", "n"))
    symbols = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
    fine = np.frombuffer(b"".join(table["fine"].to_pylist()), np.uint64).reshape(-1, FINE // 64)
    found_a, found_b = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        open_rows = np.arange(lo, hi)
        distance, source = np.full(hi - lo, FINE + 1), np.full(hi - lo, -1)
        while len(open_rows):
            k = int(distance[open_rows - lo].argmin())
            at = open_rows[k]
            if 0 < distance[at - lo] <= limits.fine_radius:
                found_a.append(node[at])
                found_b.append(node[source[at - lo]])
            open_rows = np.delete(open_rows, k)
            same = component[open_rows] == component[at]
            to = open_rows[~same & limits.sizes(n[open_rows], n[at])]
            to = to[(symbols[to] != symbols[at]).sum(axis=1) <= limits.radius]
            own = np.maximum(np.bitwise_count(fine[to] ^ fine[at]).sum(axis=1, dtype=np.int64), 1)
            closer = own < distance[to - lo]
            distance[to[closer] - lo], source[to[closer] - lo] = own[closer], at
            distance[open_rows[same] - lo] = 0
    if found_a:
        yield _pair_batch([np.array(found_a)], [np.array(found_b)])


def _links_of(limits: Limits, table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each block's pairs of part i with part j whose full sets reach the similarity, but for those that its earlier ones join: no more pairs than rows."""
    node, component, n, part, i, j = (table[c].to_numpy() for c in ("node", "component", "n", "part", "i", "j"))
    symbols = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
    fine = np.frombuffer(b"".join(table["fine"].to_pylist()), np.uint64).reshape(-1, FINE // 64)
    sets = table["set"].combine_chunks()
    members, first = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy().astype(np.int64)
    found_a, found_b = [], []
    component = component.copy()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        left = np.flatnonzero(part[lo:hi] == i[lo]) + lo
        right = np.flatnonzero(part[lo:hi] == j[lo]) + lo
        for at in left:
            to = right[(component[right] != component[at]) & limits.sizes(n[right], n[at])]
            if i[lo] == j[lo]:
                to = to[to > at]
            to = to[(symbols[to] != symbols[at]).sum(axis=1) <= limits.radius]
            to = to[np.bitwise_count(fine[to] ^ fine[at]).sum(axis=1, dtype=np.int64) <= limits.fine_radius]
            if not len(to):
                continue
            common = overlaps(members, first, at, to)
            for k in to[100 * common >= limits.percent * (n[to] + n[at] - common)]:
                if component[k] != component[at]:
                    found_a.append(node[at])
                    found_b.append(node[k])
                    own = component[lo:hi]
                    own[own == component[k]] = component[at]
    if found_a:
        yield _pair_batch([np.array(found_a)], [np.array(found_b)])


def overlaps(members: np.ndarray, first: np.ndarray, at: int, to: np.ndarray) -> np.ndarray:
    """How many members of row at's sorted set those of rows `to` have, none of which is empty; first: where each row's members begin."""
    own, sizes = members[first[at] : first[at + 1]], first[to + 1] - first[to]
    starts = np.cumsum(sizes) - sizes
    others = members[np.arange(starts[-1] + sizes[-1]) + np.repeat(first[to] - starts, sizes)]
    place = np.minimum(np.searchsorted(own, others), len(own) - 1)
    return np.add.reduceat(own[place] == others, starts, dtype=np.int64)


def _pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def texts_of(documents: DataFrame, classes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One text of each class in nodes, and (node, class) of those."""
    wanted = checkpointed(nodes.distinct().join(classes.select("node", "class", "doc_id"), "node"))
    texts = semi_by_size(documents.select("doc_id", "text"), wanted.select("doc_id").distinct(), "doc_id")
    return texts.select("text"), wanted.select("node", "class")


def sets_of(documents: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set of some nodes."""
    texts, wanted = texts_of(documents, classes, nodes)
    sets = texts.mapInArrow(_sets, "class binary, set array<bigint>").dropDuplicates(["class"])
    return checkpointed(sets.join(wanted, "class").select("node", "set"))


def confirm(documents: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose full shingle sets reach the similarity."""
    ends = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct())
    sets = sets_of(documents, classes, ends)
    if (sets.agg(F.sum(64 + 8 * F.size("set"))).first()[0] or 0) <= SET_BYTES:
        sets = F.broadcast(sets)
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    return both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).cast("bigint").alias("total")).where(
        f"100 * common >= {percent} * (total - common)"
    ).select("a", "b")


def dealt(rows: DataFrame, parts: F.Column) -> DataFrame:
    """rows (key, node) in so many parts of their key, each row once for every pair (i, j) of parts that has its own."""
    rows = rows.withColumn("parts", parts.cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("parts", "other")


def in_blocks(rest: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows (key, node, members, component) with sketches, dealt and sorted by key and pair of blocks (i, j) of its rows."""
    rest = dealt(rest, F.ceil(F.col("members") / BLOCK)).select("key", "node", "component", "part", "i", "j")
    rest = rest.join(sketches, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rest.select("key", "i", "j", "part", "node", "component", "n", "signature", "fine")


def within_families(near: DataFrame, labels: DataFrame, sketches: DataFrame, documents: DataFrame, classes: DataFrame, limits: Limits) -> DataFrame:
    """Links (a, b) between components of one family; families are what pairs `near` and components join among the sketched nodes."""
    rows = sketches.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    families = connected(near.select("a", "b").union(rows.select("node", "component"))).withColumnRenamed("component", "key")
    rows = checkpointed(rows.join(families, "node"))
    weight = F.sum(F.lit(ROW_BYTES) + 8 * F.col("n"))
    tally = rows.groupBy("key").agg(F.count("*").alias("members"), weight.alias("bytes"), F.min("component").alias("low"), F.max("component").alias("high"))
    tally = checkpointed(tally.where("low <> high").select("key", "members", "bytes"))
    rows = checkpointed(rows.join(by_size(tally, ROW_BYTES), "key"))
    rows = rows.join(sets_of(documents, classes, rows.select("node")), "node")
    members = F.col("members")
    parts = F.ceil(F.greatest(F.least(members / SIDE, F.lit(SIDES)), members / BLOCK, F.col("bytes") / SIDE_BYTES))
    rows = dealt(rows, parts).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    rows = rows.select("key", "i", "j", "part", "node", "component", "n", "signature", "fine", "set")
    return checkpointed(rows.mapInArrow(_blocks(partial(_links_of, limits)), "a bigint, b bigint"))


def sketches_of(documents: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, signature, fine of some nodes."""
    texts, wanted = texts_of(documents, classes, nodes)
    fine = texts.mapInArrow(_fine, "class binary, fine binary").dropDuplicates(["class"]).join(wanted, "class").select("node", "fine")
    return checkpointed(classes.select("node", "n", "signature").join(fine, "node"))


def linked(rows: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """class, component (a node) and component_id of the classes of signed rows (doc_id, n_shingles, class, signature)."""
    bounded_batches(documents.sparkSession)
    limits = limits_at(percent)
    classes = rows.where("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")
    )
    classes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))

    keys = classes.select("node", F.explode(chunk_keys(F.col("signature"))).alias("key"))
    tally = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("low"), F.max("node").alias("high"))
    met = checkpointed(keys.join(tally.where("members > 1"), "key"))
    shared = met.select("key", "node", "members")

    info = classes.select("node", "n", "signature")
    star = met.select("node", F.explode(F.array("low", "high")).alias("to")).where("node <> to").distinct()
    star = star.join(info, "node").join(info.toDF("to", "n_to", "signature_to"), "to").select("node", "to", "n", "n_to", "signature", "signature_to")
    star = star.mapInArrow(partial(_near, limits), "node bigint, to bigint, distance int")
    best = star.groupBy("node").agg(F.min("to").alias("x"), F.max("to").alias("y"), F.min_by("to", F.struct("distance", "to")).alias("z"))
    best = best.select("node", F.explode(F.array("x", "y", "z")).alias("to"))
    pairs = checkpointed(best.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct())
    links = checkpointed(confirm(documents, classes, pairs, percent))
    labels = checkpointed(connected(links))

    # What is still apart within a key: first the nearest ones, then all pairs of different components that are left.
    labelled = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    rest = checkpointed(labelled.join(apart, "key"))
    sketches = sketches_of(documents, classes, rest.select("node"))
    near = checkpointed(in_blocks(rest, sketches).mapInArrow(_blocks(partial(_forests, limits)), "a bigint, b bigint").distinct())
    if not near.isEmpty():
        links = checkpointed(links.union(confirm(documents, classes, near.join(pairs, ["a", "b"], "left_anti"), percent)))
        labels = checkpointed(connected(links))
        more = within_families(near, labels, sketches, documents, classes, limits)
        if not more.isEmpty():
            labels = checkpointed(connected(links.union(more)))

    found = classes.select("class", "node", "doc_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(smallest, "component").select("class", "component", "component_id")


def signed(documents: DataFrame) -> DataFrame:
    bounded_batches(documents.sparkSession)
    return checkpointed(documents.mapInArrow(_sign, "doc_id bigint, n_shingles bigint, class binary, signature binary"))


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents (doc_id, text); sets are linked from percent on."""
    documents = documents.select("doc_id", "text")
    rows = signed(documents)
    named = checkpointed(linked(rows, documents, percent)).select("class", "component_id")
    rows = rows.select("doc_id", "n_shingles", "class")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    result = rows.where("n_shingles > 0").join(by_size(named, ROW_BYTES), "class").select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _sign(iter([batch.select([0, 1])])):
            yield pa.RecordBatch.from_arrays([*part.columns, batch.column(2)], [*part.schema.names, "content"])


def drop_near_duplicates(documents: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """documents with one row left of each group of near duplicates.

    The row that stays has the group's smallest doc_id (null after all others), then the smallest digest of its text, then the
    smallest row as JSON. Rows with an empty set are in no group and all stay, as do unrelated texts under one doc_id or under none.
    """
    bounded_batches(documents.sparkSession)
    content = F.unhex(F.md5("text"))
    rows = documents.select("doc_id", "text", content.alias("content")).mapInArrow(
        _keyed, "doc_id bigint, n_shingles bigint, class binary, signature binary, content binary"
    )
    rows = checkpointed(rows)
    named = checkpointed(linked(rows, documents.select("doc_id", "text"), percent)).select("class", "component")
    texts = rows.where("n_shingles > 0").groupBy("class", "doc_id", "content").agg(F.count("*").alias("times"))
    texts = checkpointed(texts.join(by_size(named, ROW_BYTES), "class").withColumn("first", F.struct(F.col("doc_id").isNull(), "doc_id", "content")))
    first = texts.groupBy("component").agg(F.min("first").alias("first"))
    first = checkpointed(first.select(F.col("component").alias("of"), F.col("first").alias("least")))
    texts = texts.join(by_size(first, ROW_BYTES), F.col("component") == F.col("of"))
    lost = texts.where("first <> least").select("doc_id", "content")
    kept = semi_by_size(documents, lost, {"doc_id": F.col("doc_id"), "content": content}, "left_anti")
    repeated = checkpointed(texts.where("first = least and times > 1").select("doc_id", "content"))
    if repeated.isEmpty():
        return kept
    key = {"doc_id": F.col("doc_id"), "content": content}
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in documents.columns])
    once = semi_by_size(kept, repeated, key).groupBy(F.col("doc_id").alias("id"), content.alias("text_digest")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return semi_by_size(kept, repeated, key, "left_anti").unionByName(once.select("row.*"))
