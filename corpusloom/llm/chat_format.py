"""Chat formatting as a prefix tree: shared first turns are emitted once, depth first.

A conversation is a path of turns. Each turn becomes one node's text, `### role:` and a line with the escaped text and
`</turn>`. Conversations that begin with equal turns share those nodes. Sorting conversations by their paths
of chained node names puts the tree in depth-first order, and range partitions of that order are packs: a pack emits each
node once where it first comes up, with the position ids its characters have in their conversation (start and length, as
they are consecutive), and the attention intervals of its ancestors in the pack. A subtree of any size spreads over as many packs as it
needs, and only its shared path is emitted again at the start of each.

Starts, positions and intervals count characters, or tokens where an encoder is given (any function from a text to a list
of token ids that can be pickled); a node's head, text and end are then encoded apart, so that the loss covers whole tokens.

Escaping breaks every control string in a role or text, and unescaping is its exact reverse. Rows are ordered by turn,
then role and text, nulls first; null roles and texts are empty. Repeated rows are turns of their own. A null conv_id is
a conversation, and a conversation, however long, is one row of one task. An empty table has no packs. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.generate import bounded_batches

PACK_CHARS = 1 << 18
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_HEAD, _END = "### ", "</turn>\n"


def escape(text: str) -> str:
    """text in which no `###` and no `</` is left, nor a backslash that isn't doubled or before a character that was escaped."""
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</", "<\\/")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{_HEAD}{escape(role).replace(':', chr(92) + ':')}:\n{escape(text)}{_END}"


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n(.*?)</turn>\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the text in formatted) of each turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


PACKS = (
    "nodes array<struct<name: string, text: string, start: bigint, position: bigint, loss_start: bigint, loss_end: bigint, tokens: array<int>, token_loss_start: bigint, token_loss_end: bigint, ancestors: array<struct<start: bigint, end: bigint>>>>,"
    " leaves array<struct<conv_id: bigint, intervals: array<struct<start: bigint, end: bigint>>>>"
)
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_NODE = pa.struct(
    [
        ("name", pa.string()), ("text", pa.string()), ("start", pa.int64()), ("position", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
        ("tokens", pa.list_(pa.int32())), ("token_loss_start", pa.int64()), ("token_loss_end", pa.int64()), ("ancestors", pa.list_(_SPAN)),
    ]
)
_LEAF = pa.struct([("conv_id", pa.int64()), ("intervals", pa.list_(_SPAN))])


_TURNS = "conv_id bigint, turns array<struct<turn: bigint, role: string, text: string>>"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = []
        for turns in batch.column(1).to_pylist():
            name, path = "", []
            for t in turns:
                own = hashlib.md5(f"{len(t['role'])}\0{t['role']}\0{t['text']}".encode()).hexdigest()
                name = hashlib.md5((name + own).encode()).hexdigest()
                path.append(name)
            paths.append(path)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.string()))], ["conv_id", "turns", "path"])


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (ordered), path: chained names of its nodes, each of which names all turns up to it."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select("conv_id", "turns").mapInArrow(_chain, f"{_TURNS}, path array<string>")


def _encoded(turn: dict, encode: Callable[[str], list[int]]) -> tuple[list[int], int, int]:
    """Token ids of a formatted turn, and where its text's tokens start and end."""
    text = escape(turn["text"])
    head, own, end = (encode(x) for x in (format_turn(turn["role"], "")[: -len(_END)], text, _END))
    return [*head, *own, *end], len(head), len(head) + len(own)


def _pack(batches: Iterator[pa.RecordBatch], limit: int, encode: Callable[[str], list[int]] | None) -> Iterator[pa.RecordBatch]:
    nodes: list[dict] = []
    leaves: list[dict] = []
    stack: list[tuple[str, int, int, int]] = []  # name, start and end in the pack, position after it
    size = 0

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([nodes], pa.list_(_NODE)), pa.array([leaves], pa.list_(_LEAF))], ["nodes", "leaves"])

    for batch in batches:
        for conv_id, turns, path in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if size >= limit:
                yield full()
                nodes, leaves, stack, size = [], [], [], 0
            depth = 0
            while depth < min(len(stack), len(path)) and stack[depth][0] == path[depth]:
                depth += 1
            del stack[depth:]
            for turn, name in list(zip(turns, path, strict=True))[depth:]:
                text = format_turn(turn["role"], turn["text"])
                at = stack[-1][3] if stack else 0
                loss = (len(text) - len(_END) - len(escape(turn["text"])), len(text) - len(_END)) if turn["role"] == "assistant" else (0, 0)
                ancestors = [{"start": s, "end": e} for _, s, e, _ in stack]
                tokens, low, high = _encoded(turn, encode) if encode else ([], 0, 0)
                low, high = (low, high) if loss[1] else (0, 0)
                nodes.append(
                    {"name": name, "text": text, "start": size, "position": at, "loss_start": loss[0], "loss_end": loss[1], "tokens": tokens, "token_loss_start": low, "token_loss_end": high, "ancestors": ancestors}
                )
                length = len(tokens) if encode else len(text)
                stack.append((name, size, size + length, at + length))
                size += length
            leaves.append({"conv_id": conv_id, "intervals": [{"start": s, "end": e} for _, s, e, _ in stack]})
    if leaves:
        yield full()


def packs(conversations: DataFrame, pack_chars: int = PACK_CHARS, encode: Callable[[str], list[int]] | None = None) -> DataFrame:
    """One row a pack: its nodes in depth-first order, and each conversation's intervals in the pack's text (or tokens)."""
    bounded_batches(conversations.sparkSession)
    rows = conversation_paths(conversations)
    ordered = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.select("conv_id", "turns", "path").mapInArrow(partial(_pack, limit=pack_chars, encode=encode), PACKS)


_READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _READ.split(", ")]
    for batch in batches:
        for nodes, leaves in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_start = {n["start"]: n for n in nodes}
            rows = []
            for leaf in leaves:
                path = [by_start[i["start"]] for i in leaf["intervals"]]
                whole = "".join(n["text"] for n in path)
                turns = parse(whole)
                loss = "".join(unescape(n["text"][n["loss_start"] : n["loss_end"]]) for n in path)
                said = "".join(f"{role}\n{text}\n" for role, text, *_ in turns)
                rows.append((leaf["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            columns = zip(*rows, strict=True)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def read_back(packed: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of the conversations in packs."""
    return packed.mapInArrow(_read_back, _READ)
