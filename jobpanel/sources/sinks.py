"""Partitioned sinks and run records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

FILE_ROWS = 5_000_000


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], mode: str = "overwrite") -> None:
    """Parquet folders by key. Only the partitions written are replaced.

    Rows are not shuffled by the key: a hot window would end up in one task.
    """
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", FILE_ROWS).partitionBy(*keys).parquet(path))


def write_routed(df: DataFrame, path: str, reason: str = "reject_reason") -> None:
    """Clean rows and one folder per reject reason in a single pass."""
    write_partitioned(df, path, [reason])


def write_table_and_csv(df: DataFrame, path: str, light: Sequence[str]) -> None:
    """Full Parquet table with a light CSV of selected columns beside it."""
    df.write.mode("overwrite").parquet(f"{path}/table")
    df.select(*light).write.mode("overwrite").option("header", True).csv(f"{path}/light_csv")


def write_with_record(df: DataFrame, path: str, counters: Mapping[str, Column]) -> dict:
    """Parquet write with row counters, taken from the rows as they were written.

    An Observation would save that read, but once it is used, models of MLlib can no
    longer be sent to tasks of the session.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).agg(
        F.count(F.lit(1)).alias("rows_out"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counters.items()]).first().asDict()
