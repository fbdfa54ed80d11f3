"""LM scoring with a log-frequency Bloom filter of quantised n-gram counts.

Training documents are those whose crc32(doc_id as text) mod 5 is not 1. Words (A-Z lower-cased) and bigrams are 64-bit
hashes. Tasks count what they read, hashes fall into ranges (buckets, as many as the corpus needs so that one stays small) and
each bucket's counts are summed in one place. A count is quantised to level 1 + floor(log2 count); the bucket's filter
holds the n-gram once for each level up to its own, so repeated probes, level by level until one misses, read it back.

Buckets are packed into segments of at most SEGMENT_BYTES. A pass over the documents broadcasts at most SEGMENTS of
them, so what a worker holds is bounded; where the corpus needs more segments, further passes carry each text's levels on
through a checkpoint. Scoring costs as many passes as there are segments / SEGMENTS.

The model interpolates: P(w | v) = MIXED * q(v w) / q(v) + (1 - MIXED) * (q(w) + 0.5) / (N + 0.5 (V + 1)), with q read from the
filter, and only the second term, unscaled, where v or v w is unknown. A bucket also carries the exact counts of its words,
from which the base score is taken.

A null or empty text is one end token. A null doc_id counts as an empty text for its crc32 and is used in training.
Repeated rows count again. Only doc_id and text are read. No training document: N and V are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.generate import bounded_batches
from corpusloom.llm.common import SPACE_FREE, checkpointed, mix, text_slices, word_hashes, word_spans

BITS, PROBES, MIXED = 10, 7, 0.7
BUCKET_TOKENS = 1 << 20
SEGMENT_BYTES, SEGMENTS = 64 << 20, 3
FLUSH_TOKENS = 3 << 19
END = np.uint64(0x2545F4914F6CDD1D)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' tokens, each row's end included, and the index of each row's first token."""
    starts, ends, first = word_spans(data, offsets, SPACE_FREE)
    rows = len(offsets) - 1
    out = np.full(len(starts) + rows, END, np.uint64)
    counts = np.diff(first)
    if len(starts):
        out[np.arange(len(starts)) + np.repeat(np.arange(rows), counts)] = word_hashes(data, starts, ends)
    return out, first[:-1] + np.arange(rows)


def bigrams_of(tokens: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it; the first word of a text follows an end."""
    before = np.empty_like(tokens)
    before[:1] = END
    before[1:] = tokens[:-1]
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + tokens * np.uint64(0xCA9B0C7EBA1DA115))


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.uint8)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the geometric middle of its range, 1 for level 1."""
    return np.array([0.0, 1.0] + [2.0 ** (level - 0.5) for level in range(2, 65)])[levels]


def _slots(keys: np.ndarray, level: int, probe: int, size: np.ndarray | int) -> np.ndarray:
    one = mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    two = mix(one) | np.uint64(1)
    at = (one + np.uint64(probe) * two) >> np.uint64(32)
    return ((at * np.asarray(size, np.uint64)) >> np.uint64(32)).astype(np.int64)


def build_filter(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Bits (as bytes) of a filter of keys at all levels up to their own."""
    size = max(64, int(levels.sum(dtype=np.int64)) * BITS)
    bits = np.zeros((size + 7) // 8 * 8, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= level]
        for probe in range(PROBES):
            bits[_slots(own, level, probe, len(bits))] = True
    return np.packbits(bits, bitorder="little")


class Segment:
    """Consecutive buckets: exact counts of their words and their filters, joined."""

    def __init__(self, shift: int, rows: list):
        self.shift, self.low, self.high = shift, rows[0]["bucket"], rows[-1]["bucket"] + 1
        self.words = np.concatenate([np.frombuffer(r["word_keys"], np.uint64) for r in rows])
        self.counts = np.concatenate([np.frombuffer(r["word_counts"], np.int64) for r in rows])
        parts = [np.frombuffer(r["bits"], np.uint8) for r in rows]
        self.bits = np.concatenate(parts)
        self.sizes, self.starts = np.zeros(self.high - self.low, np.int64), np.zeros(self.high - self.low, np.int64)
        at = 0
        for r, p in zip(rows, parts, strict=True):
            self.sizes[r["bucket"] - self.low], self.starts[r["bucket"] - self.low] = len(p) * 8, at * 8
            at += len(p)

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted word keys."""
        if not len(self.words):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, self.counts[at], 0)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of keys by repeated probes; 0 for those that aren't in this segment's buckets."""
        out = np.zeros(len(keys), np.uint8)
        bucket = (keys >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(keys), np.int64)
        live = np.flatnonzero((bucket >= self.low) & (bucket < self.high))
        live = live[self.sizes[bucket[live] - self.low] > 0]
        for level in range(1, 64):
            for probe in range(PROBES):
                own = bucket[live] - self.low
                slot = self.starts[own] + _slots(keys[live], level, probe, self.sizes[own])
                live = live[(self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
            if not len(live):
                break
            out[live] = level
        return out


def _count(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        words = np.concatenate(held)
        pairs = np.concatenate([bigrams_of(h) for h in held])
        for kind, values in enumerate((words, pairs)):
            keys, counts = np.unique(values, return_counts=True)
            bucket = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cuts[1:], len(keys))
            rows = [[bucket[a], kind, keys[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()] for a, b in zip(cuts, ends, strict=True)]
            columns = zip(*rows, strict=True)
            types = [pa.int64(), pa.int8(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "kind", "keys", "counts"])

    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column(0)):
            held.append(tokens_of(data, offsets)[0])
            size += len(held[-1])
            if size >= FLUSH_TOKENS:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


_BUCKET = "bucket bigint, tokens bigint, distinct bigint, word_keys binary, word_counts binary, bits binary"


def _sum_bucket(table: pa.Table) -> pa.Table:
    found = {}
    for kind in (0, 1):
        rows = table.filter(pa.compute.equal(table["kind"], kind))
        keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint32).astype(np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        found[kind] = (keys[first], np.add.reduceat(counts, first) if len(keys) else counts)
    words, counts = found[0]
    bits = build_filter(np.concatenate([words, found[1][0]]), level_of(np.concatenate([counts, found[1][1]])))
    row = [table["bucket"][0].as_py(), int(counts.sum()), len(words), words.tobytes(), counts.tobytes(), bits.tobytes()]
    types = [pa.int64()] * 3 + [pa.binary()] * 3
    return pa.table([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in _BUCKET.split(", ")])


def train(documents: DataFrame) -> tuple[DataFrame, int, int, int]:
    """Buckets of the model over documents (text), the shift from a hash to its bucket, N and V."""
    chars = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, int(chars / 6 / BUCKET_TOKENS)).bit_length()
    shift = 64 - bits
    counted = documents.select("text").mapInArrow(lambda b: _count(b, shift), "bucket bigint, kind tinyint, keys binary, counts binary")
    buckets = checkpointed(counted.groupBy("bucket").applyInArrow(_sum_bucket, _BUCKET))
    total = buckets.agg(F.sum("tokens"), F.sum("distinct")).first()
    return buckets, shift, total[0] or 0, total[1] or 0


def segments(buckets: DataFrame, shift: int, most: int = SEGMENT_BYTES) -> Iterator[Segment]:
    """The buckets in order, packed into segments of bounded size (or of one bucket)."""
    held, size = [], 0
    for row in buckets.orderBy("bucket").toLocalIterator():
        own = len(row["word_keys"]) + len(row["word_counts"]) + len(row["bits"])
        if held and size + own > most:
            yield Segment(shift, held)
            held, size = [], 0
        held.append(row)
        size += own
    if held:
        yield Segment(shift, held)


_SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
_CARRIED = "doc_id bigint, text string, n_known bigint, base_score double, levels binary"


def _pass(batches: Iterator[pa.RecordBatch], shared: list, first: bool, last: bool, n: int, v: int) -> Iterator[pa.RecordBatch]:
    """Levels of tokens and bigrams from this pass's segments added to those carried; scores in the last pass."""
    parts = [s.value for s in shared]
    smoothing = n + 0.5 * (v + 1)
    unknown = np.log10(0.5 / smoothing)
    for batch in batches:
        texts = batch.column(1)
        for i, j, data, offsets in text_slices(texts):
            tokens, starts = tokens_of(data, offsets)
            words, word_at = np.unique(tokens, return_inverse=True)
            pairs, pair_at = np.unique(bigrams_of(tokens), return_inverse=True)
            exact, levels, pair_levels = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint8), np.zeros(len(pairs), np.uint8)
            for part in parts:
                exact += part.exact(words)
                levels |= part.levels(words)
                pair_levels |= part.levels(pairs)
            gain = np.where(exact > 0, np.log10((exact + 0.5) / smoothing) - unknown, 0.0)
            sizes = np.diff(np.append(starts, len(tokens)))
            base = np.add.reduceat(gain[word_at], starts)
            known = np.add.reduceat((exact > 0)[word_at].astype(np.int64), starts)
            both = np.stack([levels[word_at], pair_levels[pair_at]])
            if first:
                base += sizes * unknown
            else:
                base += batch.column(3)[i:j].to_numpy()
                known += batch.column(2)[i:j].to_numpy()
                both |= np.frombuffer(b"".join(batch.column(4)[i:j].to_pylist()), np.uint8).reshape(-1, 2).T
            if not last:
                pairwise = both.T
                carried = [pairwise[a : a + s].tobytes() for a, s in zip(starts, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], texts[i:j], pa.array(known), pa.array(base), pa.array(carried, pa.binary())], [c.split()[0] for c in _CARRIED.split(", ")]
                )
                continue
            own, pair = count_of(both[0]), count_of(both[1])
            context = np.empty_like(own)
            context[1:] = own[:-1]
            context[starts] = own[starts + sizes - 1]
            single = (own + 0.5) / smoothing
            seen = (pair > 0) & (context > 0)
            ratio = np.minimum(1.0, pair / np.where(seen, context, 1.0))
            logs = np.log10(np.where(seen, MIXED * ratio + (1 - MIXED) * single, single))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(base), pa.array(np.add.reduceat(logs, starts))],
                [c.split()[0] for c in _SCORED.split(", ")],
            )


def held_out() -> F.Column:
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 1


def scores(documents: DataFrame, segment_bytes: int = SEGMENT_BYTES, at_once: int = SEGMENTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of documents (doc_id, text)."""
    bounded_batches(documents.sparkSession)
    context = documents.sparkSession.sparkContext
    documents = documents.select("doc_id", "text")
    buckets, shift, n, v = train(documents.where(~held_out()))
    rows, first, waiting = documents, True, []

    def step(rows: DataFrame, own: list[Segment], first: bool, last: bool) -> DataFrame:
        shared = [context.broadcast(s) for s in own]
        out = rows.mapInArrow(lambda b: _pass(b, shared, first, last, n, v), _SCORED if last else _CARRIED)
        if last:
            return out
        out = checkpointed(out)
        for s in shared:
            s.destroy()
        return out

    for segment in segments(buckets, shift, segment_bytes):
        if len(waiting) == at_once:
            rows, first, waiting = step(rows, waiting, first, False), False, []
        waiting.append(segment)
    out = step(rows, waiting, first, True)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
