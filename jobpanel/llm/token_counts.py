"""Exact token counts of a byte-pair vocabulary without calling its library's encoder.

Texts are cut before every run of word marks into pre-tokens, which no piece of
the vocabulary crosses. The distinct new pre-tokens of a batch become ragged
arrays of symbols; each round applies, in all of them at once, the best-ranked
pair each one holds, until no pair is left. What counts is the surviving symbols.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import ragged

MARK = "▁"  # stands for a space in the vocabulary
CACHE = 1_000_000  # pre-tokens whose counts a worker remembers
LONG = 64  # characters beyond which a pre-token is neither cached nor batched with short ones


class Merges:
    """Pairs of a vocabulary: which two symbols join to which piece, at which rank."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        known = [
            (library.id_to_piece(i), library.get_score(i)) for i in range(library.get_piece_size())
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        if any(MARK in piece.lstrip(MARK) for piece, _ in known):
            raise ValueError("a piece of the vocabulary crosses a word mark")
        self.ids = {piece: k for k, (piece, _) in enumerate(known)}
        self.n = len(known)
        levels = {s: k for k, s in enumerate(sorted({s for _, s in known}, reverse=True))}
        rank = {piece: levels[s] for piece, s in known}
        singles = {piece for piece in self.ids if len(piece) == 1}
        pairs = [
            (self.ids[piece[:k]], self.ids[piece[k:]], rank[piece], self.ids[piece])
            for piece in self.ids for k in range(1, len(piece))
            if piece[:k] in self.ids and piece[k:] in self.ids]
        left, right, ranks, made = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        order = np.argsort(left * self.n + right)
        self.keys = (left * self.n + right)[order]
        self.rank, self.made = ranks[order], made[order]
        if not {c for piece in self.ids for c in piece} <= singles:
            raise ValueError("a piece of the vocabulary holds a character that is no piece")
        # a rank may be applied everywhere at once when its piece is alone at it and no pair
        # that holds the piece comes before it
        self.worst = len(levels)
        together = np.ones(self.worst, dtype=bool)
        best_with = np.full(self.n, self.worst)
        np.minimum.at(best_with, left, ranks)
        np.minimum.at(best_with, right, ranks)
        shared = np.bincount([rank[p] for p in self.ids], minlength=self.worst) > 1
        for piece, k in self.ids.items():
            if best_with[k] <= rank[piece] or shared[rank[piece]]:
                together[rank[piece]] = False
        self.together = together
        # symbol of every code point; outside the vocabulary minus its UTF-8 bytes
        self.symbol = np.full(0x110000, -4, dtype=np.int32)
        self.symbol[:0x10000], self.symbol[:0x800], self.symbol[:0x80] = -3, -2, -1
        for c in singles:
            self.symbol[ord(c)] = self.ids[c]

        self.run = 0
        longest = max((len(piece) for piece in self.ids if not piece.strip(MARK)), default=0)
        if longest and self.counts([MARK * longest * 4]).tolist() == [4]:
            self.run = longest

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs; pairs that do not join have the rank `worst`."""
        key = left * self.n + right
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        joins = (self.keys[slot] == key) & (left >= 0) & (right >= 0)
        return np.where(joins, self.rank[slot], self.worst), self.made[slot]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each pre-token; a character outside the vocabulary counts its UTF-8 bytes."""
        extra = np.zeros(len(texts), dtype=np.int64)
        if self.run:  # the front of a very long run of marks falls into longest pieces, left to right
            limit = MARK * 4 * self.run
            for k, t in enumerate(texts):
                if t.startswith(limit):
                    extra[k] = (len(t) - len(t.lstrip(MARK))) // self.run - 2
            if extra.any():
                texts = [t[e * self.run:] for t, e in zip(texts, extra.tolist())]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        flat = self.symbol[points].astype(np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        out = extra
        while len(flat) > 1:
            rank, made = self.lookup(flat[:-1], flat[1:])
            rank[row[1:] != row[:-1]] = self.worst
            best = np.full(len(texts), self.worst)
            np.minimum.at(best, row[:-1], rank)
            active = best < self.worst
            if not active.all():  # finished sequences leave
                done = ~active[row]
                np.add.at(out, row[done], np.where(flat[done] < 0, -flat[done], 1))
                if done.all():
                    return out
                keep = ~done
                pair_keep = keep[:-1] & keep[1:]
                rank, made = rank[pair_keep], made[pair_keep]
                lost = np.flatnonzero(keep)
                inner = np.flatnonzero(np.diff(lost) > 1)  # pairs across removed rows do not exist
                flat, row = flat[keep], row[keep]
                full_rank = np.full(len(flat) - 1, self.worst)
                full_made = np.zeros(len(flat) - 1, dtype=np.int64)
                here = np.ones(len(flat) - 1, dtype=bool)
                here[inner] = False
                full_rank[here], full_made[here] = rank, made
                rank, made = full_rank, full_made
            hit = np.flatnonzero((rank == best[row[:-1]]) & (rank < self.worst))
            # of a run of overlapping pairs every second joins; with an unsafe rank only a row's first
            run = np.concatenate(([0], np.flatnonzero(np.diff(hit) > 1) + 1))
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            first = np.concatenate(([True], row[hit[1:]] != row[hit[:-1]]))
            take = hit[np.where(self.together[rank[hit]], place % 2 == 0, first)]
            flat[take] = made[take]
            stay = np.ones(len(flat), dtype=bool)
            stay[take + 1] = False
            flat, row = flat[stay], row[stay]
        np.add.at(out, row, np.where(flat < 0, -flat, 1))
        return out


def model_path(name: str) -> str:
    """A path as it is; a bare name is a file of the installed public vocabularies."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _merges(model: str) -> Merges:
    return Merges(model_path(model))


@functools.cache
def _remembered(model: str) -> dict[str, int]:
    return {}


def pieces(text: str) -> list[str]:
    """Pre-tokens: runs of spaces with the characters that follow, a space put before the text.

    The word mark itself counts as a space.
    """
    if not text:
        return []
    body = text.replace(MARK, " ")
    parts = body.split(" ")
    if "" not in parts:
        return [" " + p for p in parts]
    out, spaces = [], 1
    for k, p in enumerate(parts):
        if p:
            out.append(" " * spaces + p)
            spaces = 0
        spaces += k < len(parts) - 1
    if spaces:
        out.append(" " * spaces)
    return out


def count_tokens(texts: list[str | None], model: str) -> list[int]:
    """Tokens of whole texts."""
    merges, known = _merges(model), _remembered(model)
    cut = [pieces(t or "") for t in texts]
    seen = set().union(*cut)
    fresh = [p for p in seen if p not in known]
    if len(known) + len(fresh) > CACHE:
        known.clear()
        fresh = list(seen)
    fresh.sort(key=len)
    start = 0
    while start < len(fresh):  # groups of bounded size, long pre-tokens apart from short ones
        end, size = start, 0
        while end < len(fresh) and size < (20_000 if len(fresh[end]) > LONG else 400_000):
            size += len(fresh[end])
            end += 1
        group = fresh[start:end]
        known.update(zip(group, merges.counts([p.replace(" ", MARK) for p in group]).tolist()))
        start = end
    out = [sum(map(known.__getitem__, row)) for row in cut]
    for p in fresh:
        if len(p) > LONG:
            del known[p]
    return out


def counter(model: str) -> object:
    """Arrow function from text to its token count."""

    @F.arrow_udf("bigint")
    def tokens(text: pa.Array) -> pa.Array:
        out: list[int] = []
        for part in ragged.slices(text):
            out += count_tokens(part.to_pylist(), model)
        return pa.array(out, pa.int64())

    return tokens


def with_token_counts(
    docs: DataFrame, text: str = "text", model: str = "piece_bpe_32k.model", limit: int = 4096
) -> DataFrame:
    """`docs` with `n_bytes`, `n_tokens` and `over_limit`; columns of those names are replaced.

    Counts are those of the vocabulary's library without begin, end or added
    special tokens; special strings inside texts are ordinary text. Null and empty
    texts have no bytes and no tokens. Rows are independent: repeated rows, ties
    and other columns pass through, an empty table stays empty.
    """
    return docs.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"),
        "n_tokens": counter(model)(F.col(text)),
    }).withColumn("over_limit", F.col("n_tokens") > limit)
