"""Incremental versions of the file-by-file jobs (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.cleaning import first_reason, posting_key
from ..session import checkpoint


def arriving(spark: SparkSession, folder: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def clean_arrivals(stream: DataFrame, out: str, state: str, order: str = "row_id") -> StreamingQuery:
    """Newly arrived rows by the ordered rules fake, irrelevant and duplicate, each file exactly once.

    A row that passes the first two rules is a duplicate if a row of its key came before
    it: in an earlier batch, or in its own with a smaller `order`. The first rows of all
    keys are kept beside the checkpoint, one folder of narrow rows per batch, so the
    rule holds across batches and restarts. A batch that runs again rewrites its own
    folders and does not see its own keys. Keys are reduced in the tasks before they
    are exchanged, so a frequent key sends a row per task. `read_cleaned` gives the rows.
    """
    seen = f"{state}/first_rows"

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        narrow = checkpoint(batch.select(order, first_reason().alias("_reason"), posting_key().alias("_key")))
        alive = narrow.filter("_reason is null")
        firsts = alive.groupBy("_key").agg(F.min(order).alias("_first"))
        done = [f"{seen}/batch={k}" for k in _batches(spark, seen) if k < number]
        if done:
            known = spark.read.parquet(*done).select("_key").join(firsts.select("_key"), "_key", "left_semi")
            known = checkpoint(known.distinct())
            fresh = checkpoint(firsts.join(known, "_key", "left_anti"))
        else:
            fresh = checkpoint(firsts)
        fresh.write.mode("overwrite").parquet(f"{seen}/batch={number}")
        # of the keys in this batch, only the first row of a new key is no duplicate
        kept = fresh.select(F.col("_first").alias(order), F.lit(True).alias("_kept"))
        reason = F.coalesce(F.col("_reason"), F.when(F.col("_kept"), "valid").otherwise("duplicate"))
        reasons = narrow.join(kept, order, "left").select(order, reason.alias("reject_reason"))
        batch.join(reasons, order).write.mode("overwrite").partitionBy("reject_reason").parquet(f"{out}/batch={number}")

    return (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", state)
        .trigger(availableNow=True).start())


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batch folders below a folder in any file system Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))


def read_cleaned(spark: SparkSession, out: str) -> DataFrame:
    """All rows of `clean_arrivals` with `batch` and `reject_reason`."""
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


def drop_reposts(stream: DataFrame, keys: Sequence[str], time: str, delay: str = "30 days") -> DataFrame:
    """First row per key within the watermark; later copies leave."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def running_sums(stream: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Row counts and sums per key, to be written in update mode."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(m).alias(f"sum_{m}") for m in metrics]
    return stream.groupBy(*keys).agg(*aggs)


def append_partials(stream: DataFrame, keys: Sequence[str], metrics: Sequence[str], out: str, state: str) -> StreamingQuery:
    """Partial sums of every batch in a table of its own folder; `combine` adds them up.

    A batch rewrites only its folder, so a repeated batch changes nothing.
    """

    def save(batch: DataFrame, number: int) -> None:
        running_sums(batch, keys, metrics).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", state)
        .trigger(availableNow=True).start())


def combine(partials: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Yearly table from partial sums."""
    n = F.sum("n")
    return partials.groupBy(*keys).agg(
        n.alias("n"), *[(F.sum(f"sum_{m}") / n).alias(f"mean_{m}") for m in metrics])
