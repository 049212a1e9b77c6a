"""Exact duplicates through an extendible-hash index on shared files.

Keys are 64-bit hashes of the whole text. A directory maps key prefixes to buckets;
where a bucket is overfull its prefix is doubled until it fits. Each bucket has one
owner task, which chains the texts that share a key, compares their bytes and writes
the entries of its buckets to the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranks import broadcast_if_small
from ..session import checkpoint, shared_folder

CAPACITY = 100_000  # keys a bucket may hold before it splits
STEP = 6  # prefix bits by which one round of counting may deepen the directory
BROADCAST_KEYS = 1_000_000
COMBINE_BYTES = 16 << 20  # texts one task holds while it adds up copies before the exchange


def key_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def build_directory(keys: DataFrame, capacity: int = CAPACITY) -> np.ndarray:
    """First key, as unsigned number, of every bucket.

    `keys` has one row `_key` per distinct key. A bucket is a prefix; one with more
    keys than `capacity` splits in two, again and again, which doubles the
    directory. A round counts keys under the overfull prefixes `STEP` bits deeper;
    the driver holds one number for each of those.
    """
    leaves: list[tuple[int, int]] = []  # (prefix, depth)
    overfull, depth = [(0, 0)], 0
    while overfull:
        inside = keys
        if depth:
            parents = keys.sparkSession.createDataFrame([(p,) for p, _ in overfull], "_parent bigint")
            inside = keys.join(
                F.broadcast(parents), F.shiftrightunsigned(F.col("_key"), 64 - depth) == F.col("_parent"))
        depth += STEP
        counts = dict(
            inside.groupBy(F.shiftrightunsigned(F.col("_key"), 64 - depth).alias("p"))
            .agg(F.count(F.lit(1)).alias("n")).collect())
        again = []

        def split(p: int, at: int) -> None:
            low, high = p << (depth - at), (p + 1) << (depth - at)
            n = sum(counts.get(x, 0) for x in range(low, high))
            if n <= capacity:
                leaves.append((p, at))
            elif at == depth:
                (again if depth + STEP < 64 else leaves).append((p, at))
            else:
                split(2 * p, at + 1)
                split(2 * p + 1, at + 1)

        for p, at in overfull:
            split(p, at)
        overfull = again
    return np.array(sorted(p << (64 - at) for p, at in leaves), dtype=np.uint64)


def bucket_of(directory: np.ndarray) -> object:
    """Arrow function from key to bucket number."""

    @F.arrow_udf("int")
    def bucket(keys: pa.Array) -> pa.Array:
        unsigned = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        return pa.array((np.searchsorted(directory, unsigned, side="right") - 1).astype(np.int32))

    return bucket


_ROW = "_bucket int, _key bigint, _text string, _sha binary, _top {kind}, _n bigint"


def _larger(a: object, b: object) -> object:
    return b if a is None else a if b is None else max(a, b)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up equal texts of a task before the exchange, so that a hot text sends few rows."""
    held: dict[tuple, list] = {}
    size, schema = 0, None

    def flush() -> pa.RecordBatch:
        rows = [(*key, *value) for key, value in held.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        schema = batch.schema
        for bucket, key, text, sha, top, n in zip(*(c.to_pylist() for c in batch.columns)):
            entry = held.get((bucket, key, text, sha))
            if entry is None:
                held[(bucket, key, text, sha)] = [top, n]
                size += 200 + (len(text) if text else 0)
            else:
                entry[0], entry[1] = _larger(entry[0], top), entry[1] + n
        if size > COMBINE_BYTES:
            yield flush()
            held, size = {}, 0
    if held:
        yield flush()


def _owner(schema: pa.Schema) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bucket, chain, out = None, None, {}, []

        def close() -> None:
            for slot, (sha, top, n) in enumerate(chain.values()):
                out.append((bucket, key, slot, sha, top, n))

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for b, k, text, sha, top, n in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    close()
                    key, bucket, chain = k, b, {}
                entry = chain.get(text)  # compares the bytes of texts under one key
                if entry is None:
                    chain[text] = [sha, top, n]
                else:
                    entry[1], entry[2] = _larger(entry[1], top), entry[2] + n
            if out:
                yield batch_of(out)
                out.clear()
        close()
        if out:
            yield batch_of(out)

    return run


def build_index(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """Writes the index of `docs` to `folder` and returns its entries.

    `rows` has `_id`, `_key`, `_sha` of every document. Texts travel to their owner
    only where their key occurs more than once.
    """
    spark = docs.sparkSession
    keys = checkpoint(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")))
    bucket = bucket_of(build_directory(keys))
    kind = rows.schema["_id"].dataType.simpleString()
    repeated = broadcast_if_small(keys.filter("_rows > 1").select("_key"), BROADCAST_KEYS)
    alone = rows.join(keys.filter("_rows = 1"), "_key", "left_semi")
    whole = F.coalesce(F.col(text_col), F.lit(""))
    shared = (
        docs.select(F.col(id_col).alias("_id"), whole.alias("_text")).withColumn("_key", F.xxhash64("_text"))
        .join(repeated, "_key", "left_semi"))
    columns = ["_bucket", "_key", "_text", "_sha", "_top", "_n"]
    shaped = _ROW.format(kind=kind)
    texts = (
        shared.select(
            bucket(F.col("_key")).alias("_bucket"), "_key", "_text",
            F.unhex(F.sha2("_text", 256)).alias("_sha"), F.col("_id").alias("_top"), F.lit(1).cast("bigint").alias("_n"))
        .select(*columns).mapInArrow(_combined, shaped))
    single = alone.select(
        bucket(F.col("_key")).alias("_bucket"), "_key", F.lit(None).cast("string").alias("_text"), "_sha",
        F.col("_id").alias("_top"), F.lit(1).cast("bigint").alias("_n")).select(*columns)
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([
        ("bucket", pa.int32()), ("key", pa.int64()), ("slot", pa.int32()), ("sha", pa.binary()),
        ("keep_id", to_arrow_type(rows.schema["_id"].dataType)), ("group_size", pa.int64())])
    entries = (
        texts.unionByName(single).repartition("_bucket").sortWithinPartitions("_bucket", "_key")
        .mapInArrow(
            _owner(schema), f"bucket int, key bigint, slot int, sha binary, keep_id {kind}, group_size bigint"))
    entries.write.parquet(folder)
    return spark.read.schema(entries.schema).parquet(folder)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """`id_col`, `keep_id`, `group_size`, `kept`, `text_sha256`: one row per document.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the
    largest id stays; nulls are smaller than any id, and a group of null ids only
    has a null `keep_id`, which counts as its own. Rows that repeat id and text are
    the same document listed again: each counts in `group_size` and carries the same
    `kept`. `folder` is where the index goes, by default a new one in the shared
    folder. An empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/exact-index-{uuid.uuid4().hex}"
    whole = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpoint(docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(whole).alias("_key"), F.unhex(F.sha2(whole, 256)).alias("_sha")))
    index = build_index(docs, rows, id_col, text_col, folder)
    entries = index.select(F.col("key").alias("_key"), F.col("sha").alias("_sha"), "keep_id", "group_size")
    return rows.join(entries, ["_key", "_sha"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))
