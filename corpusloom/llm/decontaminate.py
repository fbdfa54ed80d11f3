"""Benchmark decontamination: an FM-index per training shard, searched backwards for test phrases.

Documents are dealt into shards of bounded bytes where they are read, so nothing is shuffled. The alphabet of a shard's
index is the benchmark's vocabulary: any other word is a 0 that no phrase can run through. Every phrase is searched from its last word by
wavelet-tree ranks; its occurrences are located from sampled suffix positions and merged into spans of hit words.

The benchmark is the query set: it is read in blocks of bounded bytes, and a later block's pass carries the spans that
earlier ones found. A block is broadcast as arrays of some 50 bytes a benchmark word. Past AT_ONCE blocks, what was found
so far is checkpointed and their broadcasts go before the next is built: cost grows with documents times blocks, and what the
driver and a worker hold does not.

Words are lower-cased (A-Z) and consist of letters, digits and all characters beyond ASCII. A phrase is any `window`
consecutive words of an item, or all of an item that has fewer. Null and empty texts have no words. A null item_id counts
as an empty one; rows with one item_id are one item. A document that is a repeated row is judged once for each row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.generate import bounded_batches
from corpusloom.llm.common import LOWER, checkpointed, free_name, text_slices
from corpusloom.llm.fm_index import FMIndex

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_BYTES, AT_ONCE = 4 << 20, 2

_TABLE = bytearray(LOWER.tobytes())
for _byte in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]:
    _TABLE[_byte] = 0x20
_TABLE = bytes(_TABLE)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_END = b"\xff"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Phrases:
    """A block of the benchmark: its vocabulary, its distinct phrases by length, and the items of each phrase, all but the vocabulary as arrays."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: n for n, item in enumerate(self.items)}
        by_size: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for item, text in items:
            words = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], np.int32)
            size = min(window, len(words))
            if size:
                own = np.lib.stride_tricks.sliding_window_view(words, size)
                rows, owners = by_size.setdefault(size, ([], []))
                rows.append(own)
                owners.append(np.full(len(own), number[item], np.int32))
        #: Of each length: distinct phrases, and of phrase p the items owners[starts[p] : starts[p + 1]].
        self.groups = []
        for size, (rows, owners) in sorted(by_size.items()):
            phrases, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            pairs = np.unique(which.ravel().astype(np.int64) * len(self.items) + np.concatenate(owners))
            starts = np.searchsorted(pairs, np.arange(len(phrases) + 1, dtype=np.int64) * len(self.items))
            self.groups.append((size, phrases.astype(np.int32), starts, (pairs % len(self.items)).astype(np.int32)))

    def find(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Of each text: its number of words, merged spans of hit words, and the items found."""
        words = (b" " + _END + b" ").join([*texts, b""]).translate(_TABLE).split() if texts else []
        lookup = self.ids | {_END: -1}
        tokens = np.fromiter(map(lookup.get, words, repeat(0)), np.int64, len(words))
        ends = np.flatnonzero(tokens < 0)
        bounds = np.concatenate([[-1], ends])
        counts = np.diff(bounds) - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        tokens[ends] = 0
        keep = np.ones(len(tokens), bool)
        keep[1:] = (tokens[1:] != 0) | (tokens[:-1] != 0)
        origin = np.flatnonzero(keep)
        index = FMIndex(tokens[origin], len(self.ids)) if len(self.ids) and tokens.any() else None
        for size, phrases, starts, owners in self.groups if index else ():
            low, high = index.search(phrases.astype(np.int64))
            hit = np.flatnonzero(low < high)
            if not len(hit):
                continue
            times = high[hit] - low[hit]
            rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            word = origin[index.locate(rows)]
            document = np.searchsorted(ends, word)
            start = word - bounds[document] - 1
            for d, s, p in zip(document.tolist(), start.tolist(), np.repeat(hit, times).tolist(), strict=True):
                spans[d].append((s, s + size))
                items[d].update(owners[starts[p] : starts[p + 1]].tolist())
        return counts.tolist(), [merged(s) for s in spans], [{self.items[n] for n in own} for own in items]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def phrase_blocks(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The benchmark in blocks of bounded bytes; at least one."""
    held, size, any_yet = [], 0, False
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        held.append((item or "", (text or "").encode()))
        size += len(held[-1][1])
        if size >= block_bytes:
            yield Phrases(held, window)
            held, size, any_yet = [], 0, True
    if held or not any_yet:
        yield Phrases(held, window)


def _with_last(items: Iterator) -> Iterator[tuple[object, bool]]:
    """Each item with whether it is the last."""
    held = next(items)
    for item in items:
        yield held, False
        held = item
    yield held, True


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, finish: Callable | None = None) -> tuple[DataFrame, str]:
    """documents with one more column, whose name comes second: struct(n_words, spans of words, item ids).

    finish: a function from (columns of documents, results) to the batch that the last block's pass hands on instead, with the
    schema of documents, so that what follows needs no further worker.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    found = free_name("decontamination", documents)
    kind = T.StructType.fromDDL("n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>")
    plain, schema = documents.schema, T.StructType([*documents.schema.fields, T.StructField(found, kind)])
    out_type = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
    at = documents.columns.index("text")
    live = []
    for number, (block, last) in enumerate(_with_last(phrase_blocks(benchmark, window, block_bytes))):
        if len(live) == AT_ONCE:
            documents = checkpointed(documents)
            while live:
                live.pop().destroy()
        shared = spark.sparkContext.broadcast(block)
        live.append(shared)
        done = finish if last else None

        def search(batches: Iterator[pa.RecordBatch], shared=shared, number=number, done=done) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch in batches:
                values = []
                for _, _, data, offsets in text_slices(batch.column(at), SHARD_BYTES):
                    raw = data.tobytes()
                    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    counts, spans, items = phrases.find(texts)
                    values += [{"n_words": n, "spans": [{"start": a, "end": b} for a, b in s], "items": sorted(i)} for n, s, i in zip(counts, spans, items, strict=True)]
                columns = batch.columns
                if number:
                    for v, old in zip(values, columns[-1].to_pylist(), strict=True):
                        both = merged([(s["start"], s["end"]) for s in old["spans"] + v["spans"]])
                        v |= {"spans": [{"start": a, "end": b} for a, b in both], "items": sorted({*old["items"], *v["items"]})}
                    columns = columns[:-1]
                yield done(columns, values) if done else pa.RecordBatch.from_arrays([*columns, pa.array(values, out_type)], [f.name for f in schema.fields])

        documents = documents.mapInArrow(search, plain if done else schema)
    return documents, found


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of documents (doc_id, text)."""
    found, name = hits(documents.select("doc_id", "text"), benchmark, window, block_bytes)
    n_hit = F.aggregate(F.col(name).spans, F.lit(0).cast("bigint"), lambda s, x: s + x.end - x.start)
    items = F.col(name).items
    return found.select(
        "doc_id", F.col(name).n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut_words(text: str, spans: list[dict]) -> str:
    """text without the given spans of words."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    kept, end = [], 0
    for span in spans:
        kept.append(raw[end : at[span["start"]][0]])
        end = at[span["end"] - 1][1]
    return b"".join([*kept, raw[end:]]).decode()


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with the removal spans cut from their texts; those left without a word go. n_chars, if there, follows."""
    names = documents.columns
    at = names.index("text")

    def cut(columns: list[pa.Array], results: list[dict]) -> pa.RecordBatch:
        kept, texts = [*columns], columns[at]
        if any(r["spans"] for r in results):
            values = [cut_words(t, r["spans"]) if r["spans"] else t for t, r in zip(texts.to_pylist(), results, strict=True)]
            kept[at] = pa.array(values, texts.type)
            if "n_chars" in names:
                k = names.index("n_chars")
                changed = pa.array([bool(r["spans"]) for r in results])
                kept[k] = pc.if_else(changed, pc.utf8_length(kept[at]).cast(kept[k].type), kept[k])
        stay = pa.array([not r["spans"] or sum(s["end"] - s["start"] for s in r["spans"]) < r["n_words"] for r in results], pa.bool_())
        return pa.RecordBatch.from_arrays(kept, names).filter(stay)

    return hits(documents, benchmark, window, block_bytes, cut)[0]
