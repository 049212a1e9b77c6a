"""Packing of tokenised texts into sequences by vector best-fit.

A piece needs tokens, one document and attention cost (its length squared); a sequence
has a capacity of each. Pieces are placed by falling length into the open sequence that
fits all three and scores best: the least weighted norm of what remains, or the largest
weighted dot product of need and remainder.

Pieces of one length are interchangeable, and so are sequences with equal remainders.
The whole order of placements therefore follows from the number of pieces of each
length. The driver places these numbers into ranges of sequences, at most a few
thousand whatever the size of the table, and every piece finds its own place by its
rank among the pieces of its length. Texts do not meet in one task, nor in the driver.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import ragged
from .columns import fresh
from .token_counts import model_path
from ..operators.ranks import broadcast_if_small
from ..session import checkpoint

OFFSET_ROWS = 300_000  # (task, length) pairs that are broadcast; more are joined by shuffle
OUT_BYTES = 8 << 20  # ids of one batch of pieces
ROUNDING = 12  # decimals at which scores count as equal


@dataclass(frozen=True)
class Limits:
    """Capacities of one sequence and the weight of each in a score."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    rule: str = "norm"  # or "dot"

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.int64)

    @property
    def longest(self) -> int:
        """Tokens of the longest piece an empty sequence takes."""
        n = min(self.tokens, int(np.sqrt(self.attention)))
        if n < 1 or self.documents < 1 or self.rule not in ("norm", "dot"):
            raise ValueError("a sequence must take at least one token and the rule be norm or dot")
        return n


@dataclass
class Plan:
    """Runs of placements in the order of (falling length, rank).

    Run i holds the places from `first[i]` on: sequences from `base[i]` on take
    `copies[i]` pieces each, the first of them at token `offset[i]`.
    """

    lengths: np.ndarray  # falling
    start: np.ndarray  # place of each length's first piece
    first: np.ndarray
    base: np.ndarray
    copies: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the rank-th piece of a length."""
        at = self.start[np.searchsorted(-self.lengths, -length)] + rank
        run = np.searchsorted(self.first, at, side="right") - 1
        turn, copy = np.divmod(at - self.first[run], self.copies[run])
        return self.base[run] + turn, self.offset[run] + copy * length


def _scores(left: np.ndarray, need: np.ndarray, limits: Limits) -> np.ndarray:
    """Lower is better."""
    share, weight = 1.0 / limits.capacity, np.array(limits.weights)
    if limits.rule == "dot":
        return np.round(-((left * share) @ (weight * need * share)), ROUNDING)
    return np.round((((left - need) * share) ** 2) @ weight, ROUNDING)


def plan(sizes: Mapping[int, int], limits: Limits = Limits()) -> Plan:
    """Places for `sizes[length]` pieces of every length, those of vector best-fit decreasing.

    Open sequences are kept as classes: ranges of sequences with one remainder. Ties
    of the score go to the lower sequence.
    """
    capacity, total = limits.capacity, 0
    left, base, count = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = sorted((n for n, c in sizes.items() if c), reverse=True)
    runs: list[tuple[int, int, int, int]] = []
    start, place = [], 0
    for length in lengths:
        need, todo = np.array([length, 1, length * length], dtype=np.int64), sizes[length]
        start.append(place)
        room = (left // need).min(axis=1)
        taken = np.zeros(len(left), np.int64)  # pieces every sequence of a class takes
        cuts = []  # classes that split: (class, sequences, pieces) from their front
        open_ = np.flatnonzero(room)
        if limits.rule == "norm":
            # what was just filled scores better still, so a sequence is filled before the next one
            order = open_[np.lexsort((base[open_], _scores(left[open_], need, limits)))]
            for c in order.tolist():
                if not todo:
                    break
                k, n = int(room[c]), int(count[c])
                runs.append((place, int(base[c]), k, int(capacity[0] - left[c, 0])))
                put = min(todo, k * n)
                if put == k * n:
                    taken[c] = k
                else:
                    cuts.append((c, [(put // k, k), (1 if put % k else 0, put % k)]))
                place, todo = place + put, todo - put
        else:
            # what was just filled scores worse, so the sequences of a class take one piece each in turn
            step = np.repeat(open_, room[open_])
            turn = np.arange(len(step)) - np.repeat(np.cumsum(room[open_]) - room[open_], room[open_])
            score = _scores(left[step] - turn[:, None] * need, need, limits)
            for i in np.lexsort((base[step], score)).tolist():
                if not todo:
                    break
                c, n = int(step[i]), int(count[step[i]])
                runs.append((place, int(base[c]), 1, int(capacity[0] - left[c, 0] + turn[i] * length)))
                put = min(todo, n)
                if put == n:
                    taken[c] += 1
                else:
                    cuts.append((c, [(put, int(turn[i]) + 1)]))
                place, todo = place + put, todo - put
        left = left - taken[:, None] * need
        for c, parts in cuts:
            before = left[c].copy() + taken[c] * need
            for n, k in parts:
                if n:
                    left = np.vstack([left, before - k * need])
                    base, count = np.append(base, base[c]), np.append(count, n)
                    base[c] += n
                    count[c] -= n
        if todo:
            k = int((capacity // need).min())
            runs.append((place, total, k, 0))
            for n, copies in ((todo // k, k), (1 if todo % k else 0, todo % k)):
                if n:
                    left = np.vstack([left, capacity - copies * need])
                    base, count = np.append(base, total), np.append(count, n)
                    total += n
            place += todo
        alive = (count > 0) & (left > 0).all(axis=1)
        left, base, count = left[alive], base[alive], count[alive]
    first, where, copies, offset = (np.array(x, dtype=np.int64) for x in (zip(*runs) if runs else ((),) * 4))
    return Plan(np.array(lengths, dtype=np.int64), np.array(start, dtype=np.int64), first, where, copies, offset, total)


# --- token ids -----------------------------------------------------------------------

def _byte_of() -> dict[str, int]:
    """Byte of every character by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@functools.cache
def encoder(model: str) -> Callable[[str], np.ndarray]:
    """Function from text to the ids the tokenizers library gives, without special tokens put around.

    A byte-level vocabulary whose ids are in the order of its merges is read into
    tiktoken, which gives the same ids several times faster; texts it declines
    (very long runs of white space) and other vocabularies go through the library.
    """
    from tokenizers import Tokenizer

    path = model_path(model)
    library = Tokenizer.from_file(path)

    def plain(text: str) -> np.ndarray:
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cutter, bpe, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe.get("merges", [])]
    ranks = [bpe["vocab"].get(a + b) for a, b in merges] if bpe.get("type") == "BPE" else [None]
    usual = (
        None not in ranks and ranks == sorted(ranks) and spec.get("normalizer") is None
        and spec.get("post_processor") is None and not bpe.get("ignore_merges")
        and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
        and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")))
    if not usual:
        return plain
    import tiktoken
    from public_tokenizers import PATTERN

    special = {t["content"]: t["id"] for t in added}
    byte_of = _byte_of()
    vocabulary = {bytes(map(byte_of.__getitem__, p)): i for p, i in bpe["vocab"].items() if p not in special}
    fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return plain(text)

    return encode


def _pieces(
    batches: Iterator[pa.RecordBatch], model: str, end: int, longest: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """Pieces of the texts of one task with their rank among its pieces of that length."""
    encode, part = encoder(model), TaskContext.get().partitionId()
    seen = np.zeros(longest + 1, dtype=np.int64)
    tail = np.array([end], dtype=np.uint32)

    def batch(keys: pa.Array, row: np.ndarray, piece: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(length, kind="stable")
        same, begin, n = np.unique(length[order], return_index=True, return_counts=True)
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - np.repeat(begin, n) + np.repeat(seen[same], n)
        seen[same] += n
        cuts = np.append(0, np.cumsum(length)) * 4
        data = pa.Array.from_buffers(
            pa.binary(), len(length), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])
        columns = [keys.take(pa.array(row)), piece, start, length, data, np.full(len(length), part), rank]
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    for b in batches:
        at = 0
        for texts in ragged.slices(b.column(1)):
            keys = b.column(0).slice(at, len(texts))
            at += len(texts)
            known: dict[str, np.ndarray] = {}
            found = []
            for t in texts.to_pylist():
                t = t or ""
                if t not in known:
                    known[t] = np.append(encode(t), tail)
                found.append(known[t])
            total = np.array([len(f) for f in found])
            n = -(-total // longest)
            row = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            front = total - (n - 1) * longest  # the first piece may be shorter
            start = np.where(piece > 0, np.repeat(front, n) + (piece - 1) * longest, 0)
            length = np.where(piece > 0, longest, np.repeat(front, n))
            ids = np.concatenate(found)
            place = np.append(0, np.cumsum(length))
            low = 0
            while low < len(row):
                high = max(low + 1, int(np.searchsorted(place, place[low] + OUT_BYTES // 4, side="right")) - 1)
                cut = slice(low, high)
                yield batch(keys, row[cut], piece[cut], start[cut], length[cut], ids[place[low]:place[high]])
                low = high


# --- operator ------------------------------------------------------------------------

def _placed(found: Plan) -> object:
    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = found.places(
            *(a.to_numpy(zero_copy_only=False).astype(np.int64) for a in (length, rank)))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    return place


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "byte_bpe_50k.json",
    end: int = 2, limits: Limits = Limits(),
) -> DataFrame:
    """One row per piece: id, `piece`, `start`, `length`, `ids`, `sequence_id` and `offset`.

    A text becomes its token ids and the id `end`; one that no sequence takes whole is
    cut into pieces of the longest length that fits, of which the first may be shorter.
    `ids` holds a piece's ids as little-endian 32-bit numbers, `start` is how many ids
    of its row come before it, `offset` its place in the sequence. Places are gapless
    from 0, sequences are numbered from 0, and no sequence passes any of the limits.
    Null and empty texts have the id `end` only. Every row is packed on its own, so
    repeated rows and null ids stay; an empty table gives an empty one. Other columns
    are not read; an added name that the id has gets an underscore in front.
    """
    piece, start, length, ids, sequence_id, offset = fresh(
        [id_col], "piece", "start", "length", "ids", "sequence_id", "offset")
    longest = limits.longest
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    layout = f"_id {kind}, piece int, start bigint, length bigint, ids binary, _part int, _rank bigint"
    schema = pa.schema([
        ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
        ("_part", pa.int32()), ("_rank", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            def every() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            whole = pa.schema([pa.field("_id", first.schema.field(0).type), *schema])
            yield from _pieces(every(), model, end, longest, whole)

    # ranks hold for what was written: a task that runs again replaces its rows as a whole
    pieces = checkpoint(rows.mapInArrow(cut, layout))
    counts = checkpoint(pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")))
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(broadcast_if_small(offsets, OFFSET_ROWS), ["_part", "length"])
    at = ranked.withColumn("_at", _placed(plan(sizes, limits))("length", F.col("_before") + F.col("_rank")))
    return at.select(
        F.col("_id").alias(id_col), F.col("piece").alias(piece), F.col("start").alias(start),
        F.col("length").alias(length), F.col("ids").alias(ids), F.col("_at.sequence_id").alias(sequence_id),
        F.col("_at.offset").alias(offset))
