"""Text quality by a generalised additive model with pairwise interactions.

Every feature has bins and a table of logits; chosen pairs of features have a
two-way table on coarser bins. Tables are learned by boosting shallow trees on one
feature after the other, in cycles; a score is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import ragged
from .columns import packed

TRAINING_ROWS = 20_000  # most labelled rows the model is fitted on, drawn by hash of their ids
BINS, PAIR_BINS = 48, 8
CYCLES, PAIR_CYCLES, PAIRS = 160, 60, 12
RATE, LEAVES, RIDGE = 0.1, 4, 1.0

FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_word_share", "upper_share", "digit_share", "space_share",
    "stop_share", "comma_share", "bar_share", "symbol_share", "mark_share", "high_share", "log_lines", "words_per_line",
    "short_line_share", "distinct_words", "repeated_next", "distinct_pairs", "distinct_lines", "words_per_stop",
    "upper_word_share", "longest_word")
_CLASSES = {  # bytes per class
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\n", "stop": b".!?", "comma": b",;:",
    "bar": b"|", "symbol": b"#$%&*@^~_=+<>/\\{}[]", "mark": b"\"'()-`", "line": b"\n"}


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a ragged array by row."""
    upto = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    if not len(hashes):
        return np.zeros(n)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
    return np.bincount(r[fresh], minlength=n).astype(float)


def _features(column: pa.Array) -> np.ndarray:
    buffer, offsets = ragged.text_bytes(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    count = {}
    for name, members in _CLASSES.items():
        table = np.zeros(256, dtype=np.uint8)
        table[list(members)] = 1
        count[name] = _per_row(table[buffer], offsets).astype(float)
    high = _per_row(buffer >= 0x80, offsets).astype(float)
    starts, ends = ragged.word_spans(buffer, offsets)
    where = np.searchsorted(starts, offsets)
    hashes, row = ragged.word_hashes(buffer, starts, ends), ragged.owners(where)
    words = np.diff(where).astype(float)
    wordy = np.maximum(words, 1)
    length = (ends - starts).astype(np.int64)
    upper = np.isin(buffer[starts], np.frombuffer(_CLASSES["upper"], np.uint8)) if len(starts) else np.empty(0, bool)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    same_row = row[1:] == row[:-1]
    repeated = np.bincount(row[1:][same_row & (hashes[1:] == hashes[:-1])], minlength=n)
    pairs, _, pair_row = ragged.grams(hashes, where, 2)
    # lines: their bounds, hashed by the sum of their words' hashes
    edges = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(buffer == 10) + 1, offsets[-1:])))
    line_row = np.searchsorted(offsets, edges[:-1], side="right") - 1
    word_cut = np.searchsorted(starts, edges)
    sums = np.concatenate((np.zeros(1, ragged.U64), np.cumsum(ragged.mix(hashes + np.uint64(3)))))
    line_hash = sums[word_cut[1:]] - sums[word_cut[:-1]]
    line_words = np.diff(word_cut)
    filled = line_words > 0
    lines = np.bincount(line_row[filled], minlength=n).astype(float)
    lined = np.maximum(lines, 1)
    short = np.bincount(line_row[filled & (line_words < 4)], minlength=n)
    columns = [
        np.log1p(size), np.log1p(words), _per_row(length, where) / wordy, _per_row(length > 14, where) / wordy,
        count["upper"] / some, count["digit"] / some, count["space"] / some, count["stop"] / wordy,
        count["comma"] / wordy, count["bar"] / wordy, count["symbol"] / some, count["mark"] / some, high / some,
        np.log1p(count["line"]), words / lined, short / lined, _distinct(hashes, row, n) / wordy, repeated / wordy,
        _distinct(pairs, pair_row, n) / wordy, _distinct(line_hash[filled], line_row[filled], n) / lined,
        words / (count["stop"] + 1), _per_row(upper, where) / wordy, np.log1p(longest)]
    return np.stack(columns, axis=1).astype(np.float32)


def features(column: pa.Array) -> np.ndarray:
    """One row of `FEATURES` per text; null counts as empty."""
    parts = [_features(part) for part in ragged.slices(column)]
    return np.concatenate(parts) if parts else np.empty((0, len(FEATURES)), np.float32)


@dataclass
class Model:
    """Tables of an additive model with interactions."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, f], side="right")]
        for i, j, table in self.pairs:
            out += table[
                np.searchsorted(self.coarse[i], x[:, i], side="right"),
                np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)).astype(np.float32)


def _leaf(g: float, h: float) -> float:
    return RATE * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Shallow tree over ordered bins: the best cuts one after the other, a value per bin."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    ups = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))

    def best(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        cut = np.arange(lo + 1, hi)
        gl, hl = ups[0][cut] - ups[0][lo], ups[1][cut] - ups[1][lo]
        ga, ha = ups[0][hi] - ups[0][lo], ups[1][hi] - ups[1][lo]
        gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
        k = int(np.argmax(gain))
        return float(gain[k]), int(cut[k])

    while len(parts) < leaves:
        (gain, cut), part = max((best(*p), p) for p in parts)
        if gain <= 1e-12:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    for lo, hi in parts:
        out[lo:hi] = _leaf(ups[0][hi] - ups[0][lo], ups[1][hi] - ups[1][lo])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Tree of depth two over a grid: one cut of one axis, then one of the other on either side."""
    best, out = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, len(a)):
            value, score = np.zeros_like(a), 0.0
            for side in (slice(0, cut), slice(cut, len(a))):
                row = _tree(a[side].sum(axis=0), b[side].sum(axis=0), 2)
                value[side] = row
                score += float((a[side].sum(axis=0) * row).sum())
            if score > best:
                best, out = score, value if axis == 0 else value.T
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Model of y (0 or 1); without rows it scores 0.5, with one class close to that class."""
    model = Model()
    if not len(y):
        return model
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(rate / (1 - rate)))
    n = x.shape[1]
    model.edges = [_cuts(x[:, f], BINS) for f in range(n)]
    model.coarse = [_cuts(x[:, f], PAIR_BINS) for f in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    logit = np.full(len(y), model.base)
    for _ in range(CYCLES):
        for f in range(n):
            p = 1 / (1 + np.exp(-logit))
            size = len(model.tables[f])
            step = _tree(np.bincount(bins[f], y - p, size), np.bincount(bins[f], p * (1 - p), size), LEAVES)
            model.tables[f] += step
            logit += step[bins[f]]
    cells = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    p = 1 / (1 + np.exp(-logit))

    def grid(i: int, j: int, weight: np.ndarray) -> np.ndarray:
        a, b = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(cells[i] * b + cells[j], weight, a * b).reshape(a, b)

    gains = []
    for i in range(n):
        for j in range(i + 1, n):
            g, h = grid(i, j, y - p), grid(i, j, p * (1 - p))
            if min(g.shape) > 1:
                alone = (g.sum(1) ** 2 / (h.sum(1) + RIDGE)).sum() + (g.sum(0) ** 2 / (h.sum(0) + RIDGE)).sum()
                gains.append(((g**2 / (h + RIDGE)).sum() - alone, i, j))
    model.pairs = [
        (i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)))
        for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_CYCLES):
        for i, j, table in model.pairs:
            p = 1 / (1 + np.exp(-logit))
            step = _pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)))
            table += step
            logit += step[cells[i], cells[j]]
    return model


def _vectors() -> object:
    @F.arrow_udf("array<float>")
    def vectors(text: pa.Array) -> pa.Array:
        x = features(text)
        cuts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
        return pa.ListArray.from_arrays(cuts, pa.array(x.reshape(-1)))

    return vectors


def _scorer(model: Model) -> object:
    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), len(FEATURES))
        return pa.array(model.scores(x))

    return score


def held_out(key: Column) -> Column:
    """Rows that never serve for learning."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % 3 == 1


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
    label: str = "quality", rows: int = TRAINING_ROWS,
) -> Model:
    """Model from at most `rows` labelled rows, drawn by hash of the id.

    Ids whose CRC-32 as text leaves 1 by 3 are never drawn. Rows with a null id or a
    label other than 0 and 1 teach nothing; a repeated id with the same label teaches once.
    """
    known = labels.select(F.col(label_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter(
        F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).distinct()
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows)
    taught = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(sample), "_id")
        .select("_id", "_y", _vectors()(F.col("_t")).alias("_x")).dropDuplicates(["_id", "_y"])
        .select("_x", "_y").toArrow())
    if not len(taught):
        return Model()
    x = np.array(taught["_x"].combine_chunks().flatten()).reshape(len(taught), len(FEATURES))
    y = taught["_y"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the fit does not depend on the order of arrival
    return fit(x[order], y[order])


def with_scores(docs: DataFrame, labels: DataFrame, text_col: str = "text", **columns: object) -> DataFrame:
    """`docs` with `score`, the probability of label 1 by features of the whole text; replaces a column of that name.

    Null texts count as empty and are scored as such; equal texts have equal scores.
    Without labels every score is 0.5. An empty table stays empty.
    """
    model = train(docs, labels, text_col=text_col, **columns)
    return docs.withColumn("score", _scorer(model)(_vectors()(F.col(text_col))))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: object
) -> DataFrame:
    """The documents with a score of at least 0.5, as they were."""
    rows = packed(docs, id=id_col, text=text_col)
    return with_scores(rows, labels, id_col="id", **columns).filter("score >= 0.5").select("row.*")
