"""Removal of benchmark passages from training text.

Benchmark items become a hash set of normalised word windows, which goes to every
task in blocks of bounded size. A task hashes all windows of its texts, looks
them up, verifies the hits word by word and marks the words they cover.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import checkpoint
from . import ragged
from .columns import fresh, packed

WINDOW = 13
BLOCK_WORDS = 2_000_000  # benchmark words in one broadcast block
BLOCK_BYTES = 32 << 20  # and the bytes of those words, a blank behind each

_HITS = "struct<n_words: bigint, n_hit: bigint, spans: array<bigint>, items: array<string>>"


class Windows:
    """Windows of one block of benchmark items, ready for lookup, in flat arrays.

    Per window length: sorted distinct hashes, the range of contents of each hash (more
    than one only where different windows collide), a window that shows the content,
    and the range of items that hold it.
    """

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        owner = np.array([number[name] for name, _ in items], dtype=np.int64)
        self.buffer, offsets = ragged.text_bytes(pa.array([text for _, text in items], pa.large_string()))
        self.starts, self.ends = ragged.word_spans(self.buffer, offsets)
        where = np.searchsorted(self.starts, offsets)
        hashes, sizes = ragged.word_hashes(self.buffer, self.starts, self.ends), np.minimum(np.diff(where), window)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == size)
            words = np.concatenate([np.arange(where[r], where[r + 1]) for r in rows])
            bounds = np.concatenate(([0], np.cumsum(np.diff(where)[rows])))
            keys, first, row = ragged.grams(hashes[words], bounds, size)
            self.by_length[size] = self._table(keys, words[first], owner[rows[row]], size)

    def spelled(self, at: int, size: int) -> list[bytes]:
        return spelled(self.buffer, self.starts[at:at + size], self.ends[at:at + size])

    def _table(self, keys: np.ndarray, at: np.ndarray, item: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        order = np.lexsort((item, keys))
        keys, at, item = keys[order], at[order], item[order]
        content, heads = np.zeros(len(keys), np.int64), []  # number of the content within its hash
        for i in np.flatnonzero(keys[1:] == keys[:-1]).tolist():
            if not heads or keys[heads[0][0]] != keys[i + 1]:
                heads = [(i, self.spelled(int(at[i]), size))]
            words = self.spelled(int(at[i + 1]), size)
            known = [k for k, (_, other) in enumerate(heads) if other == words]
            if not known:
                known = [len(heads)]
                heads.append((i + 1, words))
            content[i + 1] = known[0]
        order = np.lexsort((item, content, keys))
        keys, content, at, item = keys[order], content[order], at[order], item[order]
        new_key = np.append(True, keys[1:] != keys[:-1])
        new_content = new_key | np.append(True, content[1:] != content[:-1])
        once = new_content | np.append(True, item[1:] != item[:-1])
        contents, items = np.cumsum(new_content) - 1, np.cumsum(once) - 1
        return (
            keys[new_key], np.append(contents[new_key], contents[-1] + 1), at[new_content],
            np.append(items[new_content], items[-1] + 1), item[once])

    def hits(self, column: pa.Array) -> Iterable[tuple[int, int, int, list[str]]]:
        """(row, first word, end word, items) of every verified window, by row."""
        buffer, offsets = ragged.text_bytes(column)
        starts, ends = ragged.word_spans(buffer, offsets)
        hashes, where = ragged.word_hashes(buffer, starts, ends), np.searchsorted(starts, offsets)
        out = []
        for size, (keys, contents, shown, holders, item) in self.by_length.items():
            grams, first, rows = ragged.grams(hashes, where, size)
            if not len(grams):
                continue
            slot = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            for g in np.flatnonzero(keys[slot] == grams).tolist():
                at, row = int(first[g]), int(rows[g])
                words = spelled(buffer, starts[at:at + size], ends[at:at + size])
                for c in range(int(contents[slot[g]]), int(contents[slot[g] + 1])):
                    if self.spelled(int(shown[c]), size) == words:
                        begin = at - int(where[row])
                        names = [self.names[k] for k in item[holders[c]:holders[c + 1]]]
                        out.append((row, begin, begin + size, names))
        return sorted(out, key=lambda x: x[:3]), np.diff(where)


def spelled(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    if not len(starts):
        return []
    base = int(starts[0])
    text = ragged.LOWER[buffer[base:int(ends[-1])]].tobytes()
    return [text[s:e] for s, e in zip((starts - base).tolist(), (ends - base).tolist())]


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Union of half-open intervals as a flat list of bounds."""
    flat: list[int] = []
    for begin, end in sorted(spans):
        if flat and begin <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [begin, end]
    return flat


def _scan(windows: Windows) -> object:
    """Arrow function from text and the marks of earlier blocks to marks with this block's hits."""

    @F.arrow_udf(_HITS)
    def scan(text: pa.Array, before_spans: pa.Array, before_items: pa.Array) -> pa.Array:
        counts, spans, items = [], [], []
        start = 0
        for part in ragged.slices(text):
            hits, sizes = windows.hits(part)
            counts += sizes.tolist()
            new_spans: dict[int, list[tuple[int, int]]] = {}
            new_items: dict[int, set[str]] = {}
            for row, begin, end, names in hits:
                new_spans.setdefault(row, []).append((begin, end))
                new_items.setdefault(row, set()).update(names)
            for row in range(len(part)):
                had = before_spans[start + row].as_py() if before_spans[start + row].is_valid else []
                named = before_items[start + row].as_py() if before_items[start + row].is_valid else []
                pairs = list(zip(had[::2], had[1::2])) + new_spans.get(row, [])
                spans.append(_merge(pairs))
                items.append(sorted({*named, *new_items.get(row, ())}))
            start += len(part)
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array([sum(x[1::2]) - sum(x[::2]) for x in spans], pa.int64()),
             pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
            ["n_words", "n_hit", "spans", "items"])

    return scan


def _pieces(window: int, limit: int, limit_bytes: int) -> object:
    """Items as runs of their words, lower-cased, one blank behind each, within both limits.

    Neighbouring runs of an item share `window` - 1 words, so every window lies in a run
    whole and no other arises. A run holds one window at least, whatever its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch["name"].to_pylist(), batch["text"]):
                buffer, offsets = ragged.text_bytes(pa.array([value.as_py()], pa.large_string()))
                starts, ends = ragged.word_spans(buffer, offsets)
                upto = np.concatenate(([0], np.cumsum(ends - starts + 1)))
                begin, end = 0, 0
                while end < len(starts):
                    end = min(begin + limit, int(np.searchsorted(upto, upto[begin] + limit_bytes, side="right")) - 1)
                    end = min(max(end, begin + window), len(starts))
                    words = b" ".join(spelled(buffer, starts[begin:end], ends[begin:end])).decode()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([words]), pa.array([end - begin], pa.int64()),
                         pa.array([int(upto[end] - upto[begin])], pa.int64())], ["name", "text", "words", "bytes"])
                    begin = end - window + 1

    return run


def blocks(
    benchmark: DataFrame, item: str, text: str, limit: int, limit_bytes: int = BLOCK_BYTES, window: int = WINDOW,
) -> Iterable[list[tuple[str, str]]]:
    """Benchmark items in blocks of at most `limit` words and `limit_bytes` bytes.

    Words are counted by the operator's own rule, whatever parts them; longer items are
    cut into runs that overlap. Only a single window can pass the limits. Rows arrive
    partition by partition, so the driver holds one partition and one block at a time.
    Repeated items and texts are harmless.
    """
    block, n_words, n_bytes = [], 0, 0
    rows = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text"))
    runs = rows.filter("text is not null").mapInArrow(
        _pieces(window, limit, limit_bytes), "name string, text string, words bigint, bytes bigint")
    for row in runs.toLocalIterator():
        if block and (n_words + row["words"] > limit or n_bytes + row["bytes"] > limit_bytes):
            yield block
            block, n_words, n_bytes = [], 0, 0
        block.append((row["name"], row["text"]))
        n_words, n_bytes = n_words + row["words"], n_bytes + row["bytes"]
    if block:
        yield block


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` with `n_words`, `hit_spans` (flat list of half-open word intervals), `n_hit`,
    `hit_items` and `contaminated`; columns of those names are replaced.

    A window is `window` consecutive words of an item, or the whole item when it
    has fewer. A document word inside any occurrence of a window is hit; a
    document is contaminated when at least one word and a twentieth of its words
    are hit. Null or wordless texts have no words and no hits; a null, empty or
    wordless item has no windows; a null item id is spelled as empty text. Equal
    ids count as one item. An empty benchmark marks nothing. Benchmarks of more than
    `block_words` words or `block_bytes` bytes of them are scanned block after block,
    long items in overlapping runs, so the broadcast stays bounded.
    """
    marks, = fresh(docs.columns, "_marks")
    out = docs.withColumn(marks, F.lit(None).cast(_HITS))
    done = False
    for block in blocks(benchmark, item, item_text, block_words, block_bytes, window):
        if done:
            out = checkpoint(out)
        scan = _scan(Windows(block, window))
        out = out.withColumn(marks, scan(F.col(text), F.col(f"{marks}.spans"), F.col(f"{marks}.items")))
        done = True
    if not done:
        out = out.withColumn(marks, _scan(Windows([], window))(
            F.col(text), F.col(f"{marks}.spans"), F.col(f"{marks}.items")))
    out = out.withColumns({
        "n_words": F.col(f"{marks}.n_words"), "hit_spans": F.col(f"{marks}.spans"),
        "hit_items": F.col(f"{marks}.items"), "n_hit": F.col(f"{marks}.n_hit")})
    return out.withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words"))).drop(marks)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """The documents that are not contaminated, as they were."""
    return mark(packed(docs, text=text), benchmark, **options).filter("not contaminated").select("row.*")


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for value, cut in zip(text.to_pylist(), spans.to_pylist()):
        if value is None or not cut:
            out.append(value)
            continue
        buffer, offsets = ragged.text_bytes(pa.array([value], pa.large_string()))
        starts, ends = ragged.word_spans(buffer, offsets)
        data, kept, at = buffer.tobytes(), [], 0
        for begin, end in zip(cut[::2], cut[1::2]):
            kept.append(data[at:int(starts[begin])])
            at = int(ends[end - 1])
        out.append(b"".join([*kept, data[at:]]).decode())
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """All documents, hit words and what lies between them cut out of the text; null stays null."""
    marked = mark(packed(docs, text=text), benchmark, **options)
    cut = _without(F.col("text"), F.col("hit_spans"))
    return marked.select(*[cut.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
