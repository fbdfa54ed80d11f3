"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in the operators that count or shingle words.
SPACES = r"[\x20\x09-\x0D]+"

#: Most bytes that a checked broadcast may hold; a larger side is joined by shuffle instead.
BROADCAST_BYTES = 32 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; choose one only on a single machine where none is set, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loom-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: survives lost executors and cuts the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(base: str, *frames: DataFrame) -> str:
    """base, or base with underscores added until no frame has such a column (names are compared as Spark does)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base in taken:
        base += "_"
    return base


def by_size(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for a broadcast if its counted rows of such a size fit the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def semi_by_size(df: DataFrame, keys: DataFrame, on: str | dict[str, F.Column], how: str = "left_semi") -> DataFrame:
    """Semi or anti join (null-safe) of df with key columns: broadcast only while the counted keys fit the bound.

    on: the column that both have, or for each column of keys the expression over df that it must equal.
    """
    on = {on: F.col(on)} if isinstance(on, str) else on
    names = {k: free_name(f"semi_{k}", df).lower() for k in on}
    key = keys.select(*[F.col(k).alias(n) for k, n in names.items()])
    same = [value.eqNullSafe(F.col(names[k])) for k, value in on.items()]
    return df.join(by_size(key, 64 + 64 * len(on)), reduce(lambda a, b: a & b, same), how)


def word_array(text) -> F.Column:
    """Words of a text column as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


# --- vectorised word hashing -------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0][:n], _POWERS[1][:n]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_FREE = np.ones(256, bool)
SPACE_FREE[[32, 9, 10, 11, 12, 13]] = False


def text_slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row offsets into them) in runs of whole rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (one more entry than rows)."""
    inside = is_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, letters A-Z lower-cased: differences of a prefix-summed polynomial."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
