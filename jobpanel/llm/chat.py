"""Conversations as training text with a loss mask.

A turn is `### role: text</turn>` and a line feed. Inside roles and texts a
backslash goes before every backslash and control string (`### `, `</turn>`; in
roles also before a colon), so the format reads back to the same turns. Batches
are assembled by column: lengths of all segments, their running offsets and the
target of every byte, then one scatter into one buffer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import ragged

HEADER, COLON, END = b"### ", b": ", b"</turn>\n"
CONTROLS = (b"### ", b"</turn>")
PART_BYTES = 32 << 20  # a longer conversation comes in several parts

_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of formatted text."""
    at = 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError("not a formatted conversation")
        yield unescape(turn[1]), unescape(turn[2])
        at = turn.end()


def _escapes(buffer: np.ndarray, row: np.ndarray, marks: bytes) -> np.ndarray:
    """Bytes that get a backslash before them."""
    flags = np.isin(buffer, np.frombuffer(marks, np.uint8))
    for control in CONTROLS:
        n = len(control)
        if len(buffer) < n:
            continue
        hit = buffer[:len(buffer) - n + 1] == control[0]
        at = np.flatnonzero(hit)
        for k in range(1, n):
            at = at[buffer[at + k] == control[k]]
        at = at[row[at] == row[at + n - 1]]
        flags[at] = True
    return flags


class _Content:
    """One string column ready to be copied: bytes, escapes and lengths."""

    def __init__(self, column: pa.Array, marks: bytes) -> None:
        self.buffer, offsets = ragged.text_bytes(column)
        row = ragged.owners(offsets)
        self.flags = _escapes(self.buffer, row, marks)
        self.upto = np.concatenate(([0], np.cumsum(self.flags)))
        self.row, self.offsets = row, offsets
        self.lengths = np.diff(offsets) + np.diff(self.upto[offsets])

    def copy(self, out: np.ndarray, starts: np.ndarray) -> None:
        shift = starts - self.offsets[:-1] - self.upto[self.offsets[:-1]]
        target = np.arange(len(self.buffer)) + self.upto[1:] + shift[self.row]
        out[target] = self.buffer
        out[target[self.flags] - 1] = ord("\\")


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray, trained: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Formatted text and loss spans of the conversations that begin at the rows `first`.

    A loss span is a half-open range of bytes of the formatted text; the flat list
    has the escaped text of each trained turn, in order.
    """
    role, text = _Content(roles, b"\\:"), _Content(texts, b"\\")
    at_role = len(HEADER)
    at_text = at_role + role.lengths + len(COLON)
    lengths = at_text + text.lengths + len(END)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for literal, where in ((HEADER, starts), (COLON, starts + at_role + role.lengths), (END, ends - len(END))):
        out[where[:, None] + np.arange(len(literal))] = np.frombuffer(literal, np.uint8)
    role.copy(out, starts + at_role)
    text.copy(out, starts + at_text)
    bounds = np.append(starts[first], len(out))
    formatted = pa.LargeStringArray.from_buffers(
        len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
    base = np.repeat(starts[first], np.diff(np.append(first, len(starts))))
    begin = (starts + at_text - base)[trained]
    spans = np.stack([begin, begin + text.lengths[trained]], axis=1).reshape(-1)
    per = np.add.reduceat(trained.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    cuts = np.concatenate(([0], np.cumsum(2 * per))).astype(np.int32)
    return formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(spans, pa.int64()))


def _formatter(schema: pa.Schema, trained_role: str) -> object:
    def emit(table: pa.Table, part: int) -> pa.RecordBatch:
        codes = table["conv"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        trained = np.array([r == trained_role for r in table["role"].to_pylist()], dtype=bool)
        formatted, spans = assemble(
            table["role"].combine_chunks(), table["text"].combine_chunks(), first, trained)
        parts = np.zeros(len(first), dtype=np.int32)
        parts[0] = part
        return pa.RecordBatch.from_arrays(
            [table["conv"].combine_chunks().take(pa.array(first)), pa.array(parts), formatted, spans], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the conversation that is still open
        part, key = 0, object()  # next part of the open conversation, and its id
        for batch in batches:
            table = pa.Table.from_batches([batch])
            start = 0
            for piece in ragged.slices(batch["text"], PART_BYTES):
                rows = table.slice(start, len(piece))
                start += len(piece)
                rows = rows if held is None else pa.concat_tables([held, rows])
                codes = rows["conv"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
                if held is None and rows["conv"][0].as_py() != key:
                    part = 0
                open_at = int(np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))[-1])
                if open_at:
                    yield emit(rows.slice(0, open_at), part)
                    part = 0
                held = rows.slice(open_at)
                key = held["conv"][0].as_py()
                if held.nbytes > PART_BYTES:
                    yield emit(held, part)
                    held, part = None, part + 1
        if held is not None:
            yield emit(held, part)

    return run


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """`conv`, `part`, `formatted`, `loss_spans`: one row per conversation, turns in order.

    Turns are ordered by `turn`, then role and text, nulls first; repeated rows
    are turns of their own. Null roles and texts count as empty, a null id is a
    conversation of its own. Loss spans are bytes of `formatted`, two per turn of
    `trained_role`. A conversation beyond 32 MB comes in several parts, numbered
    from 0, so that no task holds a whole one. Other columns of the input are not
    read. Rows of a conversation leave in order within one partition.
    """
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    kind = rows.schema["conv"].dataType.simpleString()
    schema = pa.schema([
        ("conv", _arrow(rows, "conv")), ("part", pa.int32()), ("formatted", pa.string()),
        ("loss_spans", pa.list_(pa.int64()))])
    out = ordered.mapInArrow(
        _formatter(schema, trained_role),
        f"conv {kind}, part int, formatted string, loss_spans array<bigint>")
    return out.withColumnRenamed("conv", conv)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from `format_conversations`: turn count, SHA-256 of all turns,
    code points and SHA-256 of the unescaped text under the loss mask, and formatted code points."""
    frame = formatted.withColumnRenamed(conv, "conv")
    kind = _arrow(frame, "conv")
    schema = pa.schema([
        ("conv", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        state: list | None = None

        def close() -> list:
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]

        for batch in batches:
            for key, part, text, spans in zip(*(batch[c].to_pylist() for c in ("conv", "part", "formatted", "loss_spans"))):
                if part == 0:
                    if state is not None:
                        done.append(close())
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[5] += len(text)
                for role, content in read_back(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{content}\n".encode())
                data = text.encode()
                for begin, end in zip(spans[::2], spans[1::2]):
                    plain = unescape(data[begin:end].decode())
                    state[3] += len(plain)
                    state[4].update(plain.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in done], schema=schema)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, close()))], schema=schema)

    spark_kind = frame.schema["conv"].dataType.simpleString()
    return frame.mapInArrow(
        run, f"conv {spark_kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint").withColumnRenamed("conv", conv)
