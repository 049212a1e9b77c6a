"""Similarity join of texts on word shingles by chosen paths.

A set of shingles samples one of its tokens per hash function, the least. Two sets
of Jaccard similarity s sample the same token with probability s. From the root,
every set takes several paths, one per sampled token; sets on one path form a
bucket. Small buckets are compared by brute force on their sampled tokens; large
ones split again on two further sampled tokens each, until a split hardly makes them
smaller or a depth is reached, and are one group of candidates then. The number of paths at the root
follows from the target recall. Candidate groups are verified exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ranks import broadcast_if_small
from ..session import checkpoint, checkpoint_round
from . import ragged
from .components import components

SHINGLE = 5
THRESHOLD = (4, 5)  # similarity as a fraction
RECALL = 0.9999999
SMALL = 64  # sets a bucket may hold to be compared by brute force
DEPTH = 4  # splits after which a bucket is one candidate group
FANOUT = 2  # paths on from a large bucket
POOL = 28  # hash functions for splits below the root
ALIKE = 0.75  # share of a parent's sets from which a large bucket is one group of candidates
BLOCK_SETS, BLOCK_TOKENS = 512, 400_000  # most sets and about most tokens of one block of a candidate group
BROADCAST_SETS = 500_000


def root_paths(threshold: float, recall: float) -> int:
    """Paths at the root for which a pair at the threshold meets with probability `recall`.

    A large bucket loses a pair for good with the probability q that solves
    q = (1 - s (1 - q)) ** FANOUT; the root misses it when all its paths do.
    """
    return math.ceil(math.log(1 - recall) / math.log(_root_misses(threshold)))


def _root_misses(threshold: float) -> float:
    """Probability that one path at the root misses a pair at the threshold."""
    lost = 0.0
    for _ in range(DEPTH):
        lost = (1 - threshold * (1 - lost)) ** FANOUT
    return 1 - threshold * (1 - lost)


def least_equal(threshold: float, recall: float, roots: int, n: int) -> int:
    """Equal samples of n that a pair in a small bucket must have: paths and this cut together keep `recall`.

    The number of equal samples of a pair at the threshold is binomial; the cut takes
    what the paths at the root leave of 1 - `recall`.
    """
    left = 1 - recall - _root_misses(threshold) ** roots
    below, k = 0.0, 0
    while k < n:
        below += math.comb(n, k) * threshold ** k * (1 - threshold) ** (n - k)
        if below > left:
            break
        k += 1
    return k


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text of fewer words, but not none, is one shingle."""
    for part in ragged.slices(column):
        hashes, where = ragged.hashed_words(part)
        tokens, _, row = ragged.grams(hashes, where, size)
        cuts = np.searchsorted(row, np.arange(len(part) + 1))
        words = np.diff(where)
        for r in range(len(part)):
            if cuts[r] < cuts[r + 1]:
                yield np.unique(tokens[cuts[r]:cuts[r + 1]])
            elif words[r]:
                yield ragged.grams(hashes[where[r]:where[r + 1]], np.array([0, words[r]]), int(words[r]))[0]
            else:
                yield np.empty(0, ragged.U64)


def _set_id(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _sampled(tokens: np.ndarray, n: int) -> np.ndarray:
    """The least token under each of n hash functions, cut to 32 bits."""
    seeds = np.random.default_rng(22).integers(1, 1 << 62, n, dtype=ragged.U64)
    out = np.full(n, np.iinfo(np.uint64).max, dtype=ragged.U64)
    for at in range(0, len(tokens), 1 << 14):
        piece = tokens[at:at + (1 << 14), None] ^ seeds
        piece *= np.uint64(0xD6E8FEB86659FD93)
        piece ^= piece >> np.uint64(32)
        piece *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(out, piece.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


_SIGNATURE = "struct<cid: binary, n: int, mh: array<int>>"


def _signatures(size: int, n: int) -> object:
    @F.arrow_udf(_SIGNATURE)
    def signature(text: pa.Array) -> pa.Array:
        ids, sizes, samples = [], np.empty(len(text), np.int32), np.empty((len(text), n), np.int32)
        for row, tokens in enumerate(shingle_sets(text, size)):
            ids.append(_set_id(tokens))
            sizes[row] = len(tokens)
            samples[row] = _sampled(tokens, n)
        cuts = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * n)
        return pa.StructArray.from_arrays(
            [pa.array(ids, pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(cuts, pa.array(samples.reshape(-1)))],
            ["cid", "n", "mh"])

    return signature


def _sets(size: int) -> object:
    @F.arrow_udf("struct<cid: binary, tokens: binary>")
    def sets(text: pa.Array) -> pa.Array:
        ids, data = [], pa.BufferOutputStream()
        cuts = np.zeros(len(text) + 1, dtype=np.int64)
        for row, tokens in enumerate(shingle_sets(text, size)):
            ids.append(_set_id(tokens))
            data.write(tokens)
            cuts[row + 1] = cuts[row] + tokens.nbytes
        tokens = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(text), [None, pa.py_buffer(cuts), data.getvalue()])
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), tokens.cast(pa.binary())], ["cid", "tokens"])

    return sets


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Batches of sorted rows cut so that no group of equal keys is split, of about `rows` rows or one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = [table[k][-1] for k in keys]
        at = len(table) - 1
        while at > 0 and all(table[k][at - 1].equals(v) for k, v in zip(keys, last)):
            at -= 1
        if at:
            yield table.slice(0, at)
        held = table.slice(at).to_batches()
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks()


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row each of n rows is connected to by the pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def _brute_force(threshold: float, n: int, least: int) -> object:
    """Candidate edges inside small buckets: every set to the first of those it is linked to by `least` equal samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["bucket"], 20_000):
            bucket, sizes = table["bucket"].to_numpy(), table["n"].to_numpy()
            samples = table["mh"].combine_chunks().flatten().to_numpy().reshape(len(table), n)
            firsts, seconds = [], []
            for shift in range(1, SMALL):
                same = np.flatnonzero(bucket[shift:] == bucket[:-shift])
                if not len(same):
                    break
                other = same + shift
                fits = np.minimum(sizes[same], sizes[other]) >= threshold * np.maximum(sizes[same], sizes[other])
                same, other = same[fits], other[fits]
                alike = (samples[same] == samples[other]).sum(axis=1) >= least
                firsts.append(same[alike])
                seconds.append(other[alike])
            if not firsts:
                continue
            root = _labels(len(table), np.concatenate(firsts), np.concatenate(seconds))
            moved = np.flatnonzero(root != np.arange(len(table)))
            ids = table["cid"].combine_chunks()
            ragged.release()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(moved)), ids.take(pa.array(root[moved]))], ["a", "b"])

    return run


def candidate_edges(
    classes: DataFrame, threshold: float, roots: int, n: int, recall: float = RECALL
) -> DataFrame:
    """Edges (`a`, `b`) that connect all sets which share a path and may reach the threshold.

    A large bucket that keeps most of its parent's sets after a split holds sets that
    are alike on average; it becomes one group of candidates at once, as does what is
    large at the last depth. Every set of such a group leads to its least one.
    """
    edges = None
    least_same = least_equal(threshold, recall, roots, n)
    at_root = F.array(*[F.xxhash64(F.lit(i), F.col("mh")[i]) for i in range(roots)])
    members = classes.select("cid", F.explode(at_root).alias("bucket"), F.lit(None).cast("bigint").alias("_parent"))
    for depth in range(DEPTH + 1):
        sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_sets")).filter("_sets > 1")
        shared = checkpoint_round(members.join(sizes, "bucket"))
        small = (
            shared.filter(F.col("_sets") <= SMALL).join(classes.select("cid", "n", "mh"), "cid")
            .select("bucket", "cid", "n", "mh").repartition("bucket").sortWithinPartitions("bucket", "cid")
            .mapInArrow(_brute_force(threshold, n, least_same), "a binary, b binary"))
        edges = small if edges is None else edges.unionByName(small)
        large = shared.filter(F.col("_sets") > SMALL)
        if large.isEmpty():
            break
        alike = F.lit(depth == DEPTH) | F.coalesce(F.col("_sets") >= ALIKE * F.col("_parent"), F.lit(False))
        if depth:
            group = large.filter(alike)
            least = group.groupBy("bucket").agg(F.min("cid").alias("b"))
            edges = edges.unionByName(group.join(least, "bucket").select(F.col("cid").alias("a"), "b"))
        if depth == DEPTH:
            break
        paths = []
        for k in range(FANOUT):
            at = F.pmod(F.xxhash64("bucket", F.lit(k)), F.lit(POOL)).cast("int") + roots
            paths.append(F.xxhash64("bucket", at, F.get("mh", at)))
        members = checkpoint_round(
            large.filter(~alike).join(classes.select("cid", "mh"), "cid").select(
                "cid", F.explode(F.array_distinct(F.array(*paths))).alias("bucket"), F.col("_sets").alias("_parent")))
    return edges


def _verify(up: int, down: int) -> object:
    """Links of every set inside its cell, counted exactly, and the first set it is connected to there.

    A cell holds a whole candidate group (`whole`), one block of it, or two blocks
    whose sets are compared across only. Common tokens come from products of 0/1 matrices over slices of tokens.
    """

    def cell(table: pa.Table) -> list[tuple[bytes, int, bytes]]:
        rows = {}
        for cid, block, tokens in zip(*(table[c].to_pylist() for c in ("cid", "block", "tokens"))):
            rows.setdefault(cid, (block, np.frombuffer(tokens, np.uint64)))
        ids = sorted(rows)
        block = np.array([rows[i][0] for i in ids])
        sets = [rows[i][1] for i in ids]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        values, slot, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = times > 1
        number = np.cumsum(shared) - 1
        keep = shared[slot]
        slot, owner = number[slot[keep]], owner[keep]
        order = np.argsort(slot, kind="stable")
        slot, owner = slot[order], owner[order]
        common = np.zeros((len(sets), len(sets)), dtype=np.float32)
        width = 4096
        total = int(shared.sum())
        for at in range(0, total, width):
            lo, hi = np.searchsorted(slot, (at, at + width))
            grid = np.zeros((len(sets), min(width, total - at)), dtype=np.float32)
            grid[owner[lo:hi], slot[lo:hi] - at] = 1
            common += grid @ grid.T
        inter = common.astype(np.int64)
        union = size[:, None] + size[None, :] - inter
        linked = (inter * down >= union * up) & (union > 0)
        np.fill_diagonal(linked, False)
        if table["low"][0].as_py() < table["high"][0].as_py():  # also when one of its blocks is empty
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(linked))
        root = _labels(len(ids), a, b)
        count = linked.sum(axis=1)
        whole = table["k"][0].as_py() == 1
        return [(ids[r], int(count[r]), ids[int(root[r])], whole) for r in np.flatnonzero(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cid", pa.binary()), ("links", pa.int64()), ("root", pa.binary()), ("whole", pa.bool_())])
        for table in _whole_groups(batches, ["group", "low", "high"], 2_000):
            keys = [table[k].to_pylist() for k in ("group", "low", "high")]
            bounds = [0, *(k for k in range(1, len(table)) if any(c[k] != c[k - 1] for c in keys)), len(table)]
            out = []
            for lo, hi in zip(bounds, bounds[1:]):
                out += cell(table.slice(lo, hi - lo))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            ragged.release()

    return run


def similar_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD,
    shingle: int = SHINGLE, recall: float = RECALL,
) -> DataFrame:
    """`id_col`, `class_id`, `copy_id`, `n_links`, `n_copies`: one row per document.

    Words are lower-cased runs as in `ragged`, shingles five consecutive ones; a text
    of fewer words is one shingle. `copy_id` is the least id among the documents with
    the same set of shingles, of which there are `n_copies`; `n_links` counts the
    other sets with a Jaccard similarity of at least the threshold, copies not
    expanded; `class_id` is the least id among all documents linked directly or
    through others. Every link counted is exact; a pair at the threshold is found
    with probability `recall`, paths and the cut on equal samples together, more
    similar ones more surely. Null, empty and
    wordless texts are alone: their ids are their own, without links. Rows that
    repeat an id stay and count as copies. Null ids are larger than any other.
    An empty table gives an empty one; other columns are not read.
    """
    up, down = threshold
    share = up / down
    roots = root_paths(share, recall)
    n = roots + POOL
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    spelling = F.xxhash64("_text")
    rows = checkpoint(own.select(
        "_id", spelling.alias("_spelled"), _signatures(shingle, n)(F.col("_text")).alias("s")).select("_id", "_spelled", "s.*"))
    classes = checkpoint(
        rows.filter("n > 0").groupBy("cid").agg(
            F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_spelled")).alias("least"),
            F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("mh").alias("mh"))
        .select("cid", F.col("least._id").alias("copy_id"), F.col("least._spelled").alias("spelled"), "n_copies", "n", "mh"))
    groups = checkpoint(components(candidate_edges(classes, share, roots, n, recall)))
    # blocks of a candidate group, by its sets and tokens
    members = groups.select(F.col("node").alias("cid"), F.col("root").alias("group")).join(
        classes.select("cid", "copy_id", "spelled", "n"), "cid")
    parts = members.groupBy("group").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_SETS)), F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)))
        .cast("int").alias("k"), F.count(F.lit(1)).alias("m"))
    parts = parts.select("group", F.least("k", F.col("m").cast("int")).alias("k"))
    wanted = checkpoint(members.join(parts, "group").select(
        "cid", "copy_id", "spelled", "group", "k", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int").alias("block")))
    # the text of a set is that of its least row, known by id and spelling: ids alone may repeat or be null
    same = (F.col("d._spelled") == F.col("w.spelled")) & F.col("d._id").eqNullSafe(F.col("w.copy_id"))
    texts = own.withColumn("_spelled", spelling).alias("d").join(
        broadcast_if_small(wanted, BROADCAST_SETS).alias("w"), same)
    sets = (
        texts.select("w.*", _sets(shingle)(F.col("d._text")).alias("s"))
        .filter("s.cid = cid").select("cid", "group", "k", "block", F.col("s.tokens").alias("tokens")))
    cells = sets.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")).select(
        "group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "cid", "block", "k", "tokens")
    found = checkpoint_round(
        cells.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high")
        .mapInArrow(_verify(up, down), "cid binary, links bigint, root binary, whole boolean"))
    links = found.groupBy("cid").agg(F.sum("links").alias("n_links"))
    # only groups of several blocks are connected across cells
    split = components(found.filter("not whole").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    joined = found.filter("whole").select(F.col("cid").alias("node"), "root").unionByName(split)
    members = joined.join(classes.select(F.col("cid").alias("node"), "copy_id"), "node")
    least = members.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = members.join(least, "root").select(F.col("node").alias("cid"), "class_id").join(links, "cid")
    facts = classes.select("cid", "copy_id", "n_copies").join(named, "cid", "left")
    out = rows.select("_id", "cid", "n").join(facts, "cid", "left")
    wordy = F.col("n") > 0
    return out.select(
        F.col("_id").alias(id_col),
        F.when(wordy, F.coalesce("class_id", "copy_id")).otherwise(F.col("_id")).alias("class_id"),
        F.when(wordy, F.col("copy_id")).otherwise(F.col("_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The document with the least id of every class, with its own columns; repeated rows of it stay one.

    Wordless texts stay. Null ids are kept, since they cannot be told apart.
    """
    classes = similar_texts(docs, id_col=id_col, **options)
    gone = checkpoint(classes.filter(F.col("class_id") < F.col(id_col)).select(F.col(id_col).alias("_id")).distinct())
    twice = checkpoint(
        classes.filter(F.col(id_col).isNotNull() & (F.col("class_id") == F.col(id_col)) & (F.col("n_copies") > 1))
        .groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(id_col).alias("_id")))
    same = F.col(f"d.`{id_col}`") == F.col("o._id")
    left = docs.alias("d").join(gone.alias("o"), same, "left_anti")
    if twice.isEmpty():
        return left
    once = left.alias("d").join(twice.alias("o"), same, "left_semi").dropDuplicates([id_col])
    return left.alias("d").join(twice.alias("o"), same, "left_anti").unionByName(once)
