"""Shards of nearly equal bytes by histogram sort.

Documents are ordered by a hash of their text, so copies stay together. Rounds of
counting give the exact bytes below candidate keys in all partitions at once; the
probes between which a splitter must lie are refined until it is within tolerance.
Then every row moves once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ranks import broadcast_if_small
from ..session import checkpoint
from .columns import fresh

ROW_BYTES = 16  # what a document weighs besides its text
PROBES = 63  # candidates per splitter and round
HEAVY = 0.02  # share of a shard from which a group of copies is placed by itself
TOLERANCE = 0.001  # share of a shard by which a splitter may miss its target
SLICE_ROWS = 50_000  # rows numbered by one task

ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _histogram(probes: np.ndarray) -> object:
    """Bytes, least and largest key of a partition between neighbouring probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(probes) + 1
        size, least, most = np.zeros(n, np.int64), np.full(n, _HIGH), np.full(n, _LOW)
        for batch in batches:
            key, weight = batch["_key"].to_numpy(), batch["_size"].to_numpy()
            slot = np.searchsorted(probes, key, side="right")
            np.add.at(size, slot, weight)
            np.minimum.at(least, slot, key)
            np.maximum.at(most, slot, key)
        full = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full), pa.array(size[full]), pa.array(least[full]), pa.array(most[full])],
            ["slot", "bytes", "least", "most"])

    return run


def find_splitters(light: DataFrame, targets: list[int], slack: float) -> list[int]:
    """Keys below which the bytes of `light` come nearest to the targets, within `slack` or one group.

    A round is one job over (key, size); the driver gets one number per probe. It
    ends when every splitter is within the slack, or only one key lies between its
    bounds, at the latest when the bounds are neighbours.
    """
    brackets = [(_LOW, 0, _HIGH, None) for _ in targets]  # lower key, bytes below it, upper key, bytes below it
    found: dict[int, int] = {}
    while len(found) < len(targets):
        probes = set()
        for j, (lo, _, hi, _) in enumerate(brackets):
            if j not in found:
                step = max(1, (hi - lo) // (PROBES + 1))
                probes.update(range(lo + step, hi, step))
                probes.update((lo, hi) if lo > _LOW else (hi,))
        points = np.array(sorted(probes), dtype=np.int64)
        rows = light.mapInArrow(_histogram(points), "slot bigint, bytes bigint, least bigint, most bigint").groupBy(
            "slot").agg(F.sum("bytes"), F.min("least"), F.max("most")).collect()
        inside = np.zeros(len(points) + 1, np.int64)
        single: dict[int, int] = {}
        for slot, size, least, most in rows:
            inside[slot] = size
            if least == most:
                single[slot] = least
        below = np.cumsum(inside)  # below[i]: bytes of keys under points[i]
        for j, target in enumerate(targets):
            if j in found:
                continue
            i = int(np.searchsorted(below, target, side="left"))  # first probe with at least the target below it
            options = []
            if i < len(points):
                options.append((abs(int(below[i]) - target), int(points[i])))
            if i > 0:
                options.append((abs(int(below[i - 1]) - target), int(points[i - 1])))
            elif not options or target == 0:
                options.append((target, _LOW))
            if i == len(points) and inside[i] == 0 and i > 0:
                found[j] = int(points[i - 1])
                continue
            best = min(options)
            lo = int(points[i - 1]) if i > 0 else _LOW
            hi = int(points[i]) if i < len(points) else _HIGH
            if best[0] <= slack or hi - lo <= 1:
                found[j] = best[1]
            elif i in single:  # one group between the bounds: it goes to the nearer side
                before = int(below[i - 1]) if i > 0 else 0
                after = before + int(inside[i])
                key = single[i]
                found[j] = key if target - before <= after - target else (key + 1 if key < _HIGH else _HIGH)
            else:
                brackets[j] = (lo, 0, hi, None)
    return [found[j] for j in range(len(targets))]


def plan_shards(rows: DataFrame, n_shards: int, tolerance: float = TOLERANCE, heavy: float = HEAVY) -> object:
    """Arrow function from key to shard.

    Groups of copies above a share `heavy` of a shard, at most n_shards / heavy of
    them, go to the emptiest shard, largest first. The rest fills all shards up to
    one level; its splitters come from `find_splitters`. No other order of whole
    groups is much nearer to equal: a shard exceeds the mean only by its own
    largest group or by a light one.
    """
    total = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("s")).first()["s"]
    share = total / n_shards
    groups = rows.groupBy("_key").agg(F.sum("_size").alias("b")).filter(F.col("b") >= max(1.0, heavy * share))
    placed = sorted(((b, k) for k, b in groups.collect()), reverse=True) if total else []
    shards = [(0, s) for s in range(n_shards)]
    heapq.heapify(shards)
    where = {}
    for size, key in placed:
        load, s = heapq.heappop(shards)
        where[key] = s
        heapq.heappush(shards, (load + size, s))
    load = {s: b for b, s in shards}
    rest = total - sum(load.values())
    level, order = 0.0, sorted(load.values())
    for k in range(1, n_shards + 1):  # the level up to which the rest fills the k emptiest shards
        level = (rest + sum(order[:k])) / k
        if k == n_shards or level <= order[k]:
            break
    room = [(s, level - load[s]) for s in range(n_shards) if load[s] < level] or [(0, 0.0)]
    targets, upto = [], 0.0
    for _, r in room[:-1]:
        upto += r
        targets.append(round(upto))
    keys = np.array(sorted(where), dtype=np.int64)
    light = rows
    if len(keys):
        spark = rows.sparkSession
        light = rows.join(F.broadcast(spark.createDataFrame([(int(k),) for k in keys], "_key bigint")), "_key", "left_anti")
    splitters = find_splitters(light.select("_key", "_size"), targets, tolerance * share) if targets and rest else []
    cuts = np.array(sorted(splitters), dtype=np.int64)
    light_shards = np.array([s for s, _ in room], dtype=np.int32)
    heavy_shards = np.array([where[int(k)] for k in keys], dtype=np.int32)

    @F.arrow_udf("int")
    def shard_of(column: pa.Array) -> pa.Array:
        key = column.to_numpy(zero_copy_only=False).astype(np.int64)
        out = light_shards[np.minimum(np.searchsorted(cuts, key, side="right"), len(light_shards) - 1)]
        if len(keys):
            slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out = np.where(keys[slot] == key, heavy_shards[slot], out)
        return pa.array(out.astype(np.int32))

    return shard_of


def shard(
    docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
    tolerance: float = TOLERANCE, heavy: float = HEAVY,
) -> DataFrame:
    """`docs` with `size`, `text_crc32`, `law`, `shard`, `slot`, `grown_shard`; columns of those names are replaced.

    A column whose name differs from one of these in case only, which Spark cannot hold
    beside it, keeps its values under its name with an underscore in front (`Size`: `_Size`).
    A document weighs its UTF-8 bytes plus 16; null text weighs 16 and counts as
    empty. The law is `bytes`: sizes of shards are nearly equal, and equal texts
    share a shard. `slot` numbers the rows of a shard from 0 without gaps; rows that
    repeat id and text take neighbouring slots. Slices go by id and text together, so
    rows with null or repeated ids are split by their texts; null ids come first in a
    slice. Rows equal in both are one slice, sorted outside of memory. An empty table gives an empty one; with fewer groups than shards some shards are
    empty. `grown_shard` belongs to another law and is null.
    """
    for c in docs.columns:
        if c not in ADDED and c.lower() in ADDED:
            other, = fresh([*docs.columns, *ADDED], c)
            id_col, text_col = (other if name == c else name for name in (id_col, text_col))
            docs = docs.withColumnRenamed(c, other)
    whole = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(whole).cast("bigint") + ROW_BYTES
    rows = checkpoint(docs.select(
        F.xxhash64(whole).alias("_key"), size.alias("_size"), F.xxhash64(F.col(id_col), whole).alias("_place")))
    shard_of = plan_shards(rows, n_shards, tolerance, heavy)
    slices = max(1, math.ceil(rows.count() / n_shards / SLICE_ROWS))
    cell = F.pmod(F.col("_place"), F.lit(slices)).cast("int")
    cells = (
        rows.select(shard_of(F.col("_key")).alias("shard"), cell.alias("_slice"))
        .groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpoint(cells.select(
        "shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    key, place, part, at, own = fresh([*docs.columns, *ADDED], "_key", "_place", "_part", "_at", "_own")
    full = docs.withColumns({
        own: F.col(id_col), key: F.xxhash64(whole), place: F.xxhash64(F.col(id_col), whole), "size": size,
        "text_crc32": F.crc32(whole.cast("binary"))})
    full = full.withColumns({
        "shard": shard_of(F.col(key)), part: F.pmod(F.col(place), F.lit(slices)).cast("int")})
    order = Window.partitionBy("shard", part).orderBy(own, key)
    numbered = full.withColumn(at, F.row_number().over(order).cast("bigint") - 1)
    first = broadcast_if_small(starts, 1_000_000).alias("s")
    same = (F.col("f.shard") == F.col("s.shard")) & (F.col(f"f.{part}") == F.col("s._slice"))
    return numbered.alias("f").join(first, same).select("f.*", (F.col(f"f.{at}") + F.col("s._start")).alias(own + "_slot")).withColumns({
        "law": F.lit("bytes"), "slot": F.col(own + "_slot"), "grown_shard": F.lit(None).cast("int"),
    }).select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED], *ADDED)
