"""Sizes of Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..session import ship

ROWS = 1000  # texts are wide rows: ten thousand of them can be hundreds of megabytes
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Makes the package importable on executors and hands Python at most `ROWS` rows at a time."""
    ship(spark)
    now = int(spark.conf.get(_SETTING))
    if now <= 0 or now > ROWS:
        spark.conf.set(_SETTING, str(ROWS))
