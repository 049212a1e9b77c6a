"""Fill-in-middle form of whole texts, cut at code points through a learned rank index.

A rank index answers "at which byte does code point k begin?" for a batch of texts. It
is fitted to all boundary offsets: straight segments that stay within `ERROR` bytes of
every boundary, and for each boundary the small residual to its segment's prediction.
A cut is predicted from its segment and corrected by its residual, which is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import ragged
from .columns import fresh

ERROR = 1000  # bytes by which a segment may miss a boundary; residuals take two bytes
WINDOW = 4096  # boundaries tried at once when a segment is extended, doubled as it grows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
PLAIN_OF_100, SUFFIX_FIRST_OF_100 = 10, 20


@dataclass
class RankIndex:
    """Byte offset of every boundary: `segment` starts, their first offset and slope, and residuals."""

    first: np.ndarray  # rank of each segment's first boundary
    base: np.ndarray  # its byte offset
    slope: np.ndarray  # bytes a code point
    residual: np.ndarray  # offset minus prediction, for every boundary

    def predict(self, rank: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[k] + np.floor(self.slope[k] * (rank - self.first[k])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        return self.predict(rank) + self.residual[rank]


def _reach(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
    """End of the longest segment from boundary `at` and its slope.

    A segment holds while some slope through its first boundary stays within the
    error of all others: the cone between the steepest lower and the flattest upper
    bound seen so far is not empty.
    """
    n, low, high, done, width = len(offsets), 0.0, np.inf, at + 1, WINDOW
    while done < n:
        end = min(n, done + width)
        x = np.arange(done - at, end - at, dtype=np.float64)
        y = (offsets[done:end] - offsets[at]).astype(np.float64)
        lows = np.maximum(np.maximum.accumulate((y - error) / x), low)
        highs = np.minimum(np.minimum.accumulate((y + error) / x), high)
        shut = np.flatnonzero(lows > highs)
        if len(shut):
            k = int(shut[0])
            if k:
                low, high = lows[k - 1], highs[k - 1]
            done += k
            break
        low, high, done, width = lows[-1], highs[-1], end, width * 2
    return done, (low + high) / 2 if np.isfinite(high) else 1.0


def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """Index of rising offsets, at least one."""
    first, slope, at = [], [], 0
    while at < len(offsets):
        end, steep = _reach(offsets, at, error)
        first.append(at)
        slope.append(steep)
        at = end
    starts = np.array(first, dtype=np.int64)
    index = RankIndex(starts, offsets[starts], np.array(slope), np.zeros(len(offsets), np.int16))
    residual = offsets - index.predict(np.arange(len(offsets)))
    index.residual = residual.astype(np.int16) if error < 32_000 else residual
    return index


def boundaries(buffer: np.ndarray) -> np.ndarray:
    """Byte offset of every code point, and the end."""
    return np.append(np.flatnonzero((buffer & 0xC0) != 0x80), len(buffer))


def _draw(key: Column, group: int) -> Column:
    """One of the 8-digit groups of the key's hash as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 8 * group + 1, 8), 16, 10).cast("bigint")


def _formed(texts: pa.Array, marked: pa.Array, draws: list[np.ndarray]) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of the texts of one piece."""
    buffer, offsets = ragged.text_bytes(texts)
    cuts = boundaries(buffer)
    index = fit(cuts)
    begin = np.searchsorted(cuts, offsets)  # rank of every text's first code point
    n = np.diff(begin)
    h1, h2, h3, h4 = draws
    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    plain = (n == 0) | marked.to_numpy(zero_copy_only=False) | (h3 % 100 >= 100 - PLAIN_OF_100)
    psm = h4 % 100 >= SUFFIX_FIRST_OF_100
    to_middle, to_suffix = index.offset(begin[:-1] + low), index.offset(begin[:-1] + high)
    data = buffer.tobytes()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for k, (start, x, y, end) in enumerate(zip(
            offsets[:-1].tolist(), to_middle.tolist(), to_suffix.tolist(), offsets[1:].tolist())):
        if plain[k]:
            out.append((int(n[k]), "plain", None, None, data[start:end]))
        elif psm[k]:
            out.append((int(n[k]), "psm", int(low[k]), int(high[k] - low[k]),
                        b"".join((p, data[start:x], s, data[y:end], m, data[x:y]))))
        else:
            out.append((int(n[k]), "spm", int(low[k]), int(high[k] - low[k]),
                        b"".join((s, data[y:end], p, data[start:x], m, data[x:y]))))
    return out


_FORM = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def _transform(text: pa.Array, marked: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
    draws = [h.to_numpy(zero_copy_only=False).astype(np.int64) for h in (h1, h2, h3, h4)]
    rows, at = [], 0
    for part in ragged.slices(text):
        to = at + len(part)
        rows += _formed(part, marked.slice(at, len(part)), [d[at:to] for d in draws])
        at = to
    n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
         pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
        ["n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """`docs` with `n`, `form`, `prefix_chars`, `middle_chars` and `output`.

    A text of n code points is cut after the smaller and the larger of two drawn
    numbers of code points; `psm` puts prefix, suffix, middle behind their marks,
    `spm` suffix, prefix, middle. A tenth of the texts stays `plain`, as do empty
    ones and those that contain a mark, so every output can be taken apart again.
    Draws come from the SHA-256 of `seed:id`: equal ids draw alike, a null id draws
    as an empty one. Null text counts as empty. Rows are independent and whole,
    whatever their length; repeated rows stay, an empty table stays empty. Columns
    of the input that have one of the added names keep it, the added one gets an
    underscore in front.
    """
    names = fresh(docs.columns, "n", "form", "prefix_chars", "middle_chars", "output")
    (packed,) = fresh([*docs.columns, *names], "_made")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    made = docs.withColumn(packed, F.arrow_udf(_transform, _FORM)(text, marked, *[_draw(key, g) for g in range(4)]))
    fields = ("n", "form", "prefix_chars", "middle_chars", "output")
    return made.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        *[F.col(packed)[f].alias(name) for f, name in zip(fields, names)])


def restored(output: Column, form: Column) -> Column:
    """The text a form was made from; no part holds a mark, so the marks cut it into its parts."""
    parts = F.split(output, MARKS)
    return F.when(form == "plain", output).when(
        form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
