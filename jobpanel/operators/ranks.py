"""First rows, ranks and exact order statistics that survive hot groups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint

_OFFSET_BITS = 33  # layout of monotonically_increasing_id: partition << 33 | position


PARTIAL_LIMIT = 1000  # Spark pushes rank limits up to this size below the shuffle
_SLICES = 64


def top_per_key(df: DataFrame, keys: Sequence, order: Sequence, k: int = 1, rank: str | None = None) -> DataFrame:
    """First `k` rows per key in a total order.

    Spark turns a small rank filter into a partial limit before the shuffle, so
    a hot key sends at most `k` rows per input partition. Larger limits are
    taken in hashed slices of each key first, then over what the slices kept.
    """
    name = rank or "_rank"

    def limit(rows: DataFrame, by: Sequence) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)

    if k > PARTIAL_LIMIT:
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(_SLICES)))
        df = limit(sliced, [*keys, "_slice"]).drop("_slice", name)
    out = limit(df, keys)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def with_first(df: DataFrame, keys: Sequence[str], order: str, name: str = "first") -> DataFrame:
    """Smallest `order` of the row's key, null where the key occurs once.

    The minimum is combined on the map side; only keys with copies are joined
    back, which Spark broadcasts when they are few.
    """
    repeated = (
        df.groupBy(*keys).agg(F.min(order).alias(name), F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1").drop("_copies"))
    return join_on(df, repeated, keys, "left")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of the same names where null equals null; the keys come from the left side once."""
    same = reduce(and_, (F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys))
    taken = set(keys)
    return left.alias("l").join(right.alias("r"), same, how).select(
        "l.*", *[f"r.`{c}`" for c in right.columns if c not in taken])


def ranked(
    df: DataFrame, order: Sequence, group: Sequence[str] = (), rank: str = "rank"
) -> DataFrame:
    """Exact row numbers in a total order, with no task that holds a whole group.

    Rows are range-partitioned on (group, order); positions come from the
    partition offsets, of which there is one per partition.
    """
    sort = [*group, *order]
    placed = checkpoint(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort)
        .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", _OFFSET_BITS)
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())
    offsets, start = [], 0
    for p, n in sizes:
        offsets.append((p, start))
        start += n
    spark = df.sparkSession
    offset = F.broadcast(spark.createDataFrame(offsets, "_part bigint, _start bigint"))
    position = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1)) + 1
    out = (
        placed.withColumn("_part", part).join(offset, "_part")
        .withColumn(rank, position).drop("_at", "_part", "_start"))
    if not group:
        return out
    begins = out.groupBy(*group).agg(F.min(rank).alias("_begin"))
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    return (
        out.alias("l").join(begins.alias("r"), same).select("l.*", "r._begin")
        .withColumn(rank, F.col(rank) - F.col("_begin") + 1).drop("_begin"))


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]
) -> DataFrame:
    """Elements at index floor(n * q) of the sorted values of each key.

    Works on the histogram of the value, so it suits counts and lengths.
    """
    n = F.sum("_n").over(Window.partitionBy(*keys))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value))
    hist = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_size", n).withColumn("_upto", upto))
    picks = [
        F.min(F.when(F.col("_upto") > F.floor(F.col("_size") * q), F.col(value))).alias(name)
        for name, q in shares.items()]
    return hist.groupBy(*keys).agg(*picks)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], picks: Mapping[str, tuple[str, float]], accuracy: int = 10_000
) -> DataFrame:
    """Linearly interpolated exact quantiles per key; `picks` maps name to (column, share).

    One pass of sketches brackets every pick of every key. A second pass counts what
    lies below a bracket and the values inside it, both combined before the shuffle,
    so a hot key sends few rows; the pick is the value at its exact place. Null keys
    count as keys, null values are left out; a key without values has null picks.
    """
    keys, margin = list(keys), 2.0 / accuracy
    rows = df.select(*keys, *[
        F.col(c).cast("double").alias(f"_v_{c}") for c in dict.fromkeys(c for c, _ in picks.values())])

    def bound(c: str, q: float) -> Column:
        if q <= 0:
            return F.min(f"_v_{c}")
        return F.max(f"_v_{c}") if q >= 1 else F.percentile_approx(f"_v_{c}", q, accuracy)

    frame = rows.groupBy(*keys).agg(*[
        x for i, (c, p) in enumerate(picks.values())
        for x in (F.count(f"_v_{c}").alias(f"_n{i}"), bound(c, p - margin).alias(f"_lo{i}"), bound(c, p + margin).alias(f"_hi{i}"))])
    frame = checkpoint(frame)

    def same(a: str, b: str) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return out

    spots = F.array(*[
        F.when(F.col(f"_v_{c}").isNotNull(), F.struct(
            F.lit(i).alias("pick"), F.col(f"_n{i}").alias("n"),
            F.when(F.col(f"_v_{c}") < F.col(f"_lo{i}"), 0).when(F.col(f"_v_{c}") <= F.col(f"_hi{i}"), 1).otherwise(2).alias("side"),
            F.col(f"_v_{c}").alias("v")))
        for i, (c, _) in enumerate(picks.values())])
    inside = rows.alias("r").join(frame.alias("f"), same("r", "f")).select(
        *[f"r.{k}" for k in keys], F.explode(F.filter(spots, lambda s: s.isNotNull())).alias("s"))
    # what lies below or above is one row with the value next to the bracket, where the place may fall by rounding
    hist = inside.groupBy(*keys, "s.pick", "s.n", "s.side", F.when(F.col("s.side") == 1, F.col("s.v")).alias("_at")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("s.v").alias("_low"), F.max("s.v").alias("_high"))
    hist = hist.withColumn("v", F.when(F.col("side") == 0, F.col("_high")).otherwise(F.col("_low")))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "pick").orderBy("side", "_at"))
    place = F.get(F.array(*[F.lit(float(p)) for _, p in picks.values()]), F.col("pick")) * (F.col("n") - 1)
    at = F.floor(place)
    picked = (
        hist.withColumn("_upto", upto).groupBy(*keys, "pick").agg(
            F.min(F.when(F.col("_upto") > at, F.col("v"))).alias("_a"),
            F.min(F.when(F.col("_upto") > F.least(at + 1, F.col("n") - 1), F.col("v"))).alias("_b"),
            F.first(place - at).alias("_share"))
        .withColumn("_q", F.col("_a") + F.col("_share") * (F.col("_b") - F.col("_a")))
        .groupBy(*keys).agg(*[F.max(F.when(F.col("pick") == i, F.col("_q"))).alias(name) for i, name in enumerate(picks)]))
    return frame.select(*keys).alias("f").join(picked.alias("p"), same("f", "p"), "left").select(
        *[f"f.{k}" for k in keys], *[f"p.{name}" for name in picks])


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a side whose row count was checked; larger sides join by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shuffled(*key: str | Column, seed: int) -> Column:
    """Sort key of a random order: MD5 of the key and a seed, the same in every engine."""
    return F.md5(F.concat_ws("|", *[F.col(k) if isinstance(k, str) else k for k in key], F.lit(str(seed))))


def drawn(*key: str | Column, fraction: float, seed: int) -> Column:
    """Whether a row belongs to a random share of all rows, by the same order."""
    return F.conv(F.substring(shuffled(*key, seed=seed), 1, 8), 16, 10).cast("double") < fraction * (1 << 32)


def share_of(df: DataFrame, count: str = "n", name: str = "share") -> DataFrame:
    """Count divided by the sum over all rows."""
    whole = df.agg(F.sum(count)).scalar()
    return df.withColumn(name, F.col(count) / whole)


def keep_where(df: DataFrame, name: str, value: Column, predicate: Callable[[Column], Column]) -> DataFrame:
    """Add a costly column and keep the rows for which the predicate holds on it.

    A plain filter would be pushed below the projection and compute the column a
    second time; here it is computed once and rows without a value leave.
    """
    return df.select(
        *[c for c in df.columns if c != name],
        F.explode(F.filter(F.array(value), predicate)).alias(name))
