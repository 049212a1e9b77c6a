"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "jobpanel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `master` only for local runs."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share: the cluster's `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary one.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="jobpanel-checkpoint-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *parts: str) -> DataFrame:
    """`checkpoint` as Parquet, for tables as large as the input: checkpoints are not compressed.

    The shuffle files behind `df` go as soon as it is written, not when the driver next
    collects garbage, and what follows is planned with the measured size. A filter on
    the columns `parts` reads its own files only.
    """
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_folder(spark)}/jobpanel-{uuid.uuid4().hex}", spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path, partitionBy=list(parts) or None)
    finally:
        spark.conf.set(setting, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._jobpanel_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that `stored` returned and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._jobpanel_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_round(df: DataFrame) -> DataFrame:
    """`checkpoint` of a step that repeats: what follows is planned with the measured size of `df`.

    A plain checkpoint keeps the estimate of its plan, and that of a join is the product
    of both sides. Handed on from round to round its digits multiply, until the driver's
    memory and time go into one number.
    """
    spark, setting = df.sparkSession, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")  # else small results stay in as many tasks as a shuffle has partitions
    try:
        held = df.persist()
    finally:
        spark.conf.set(setting, before)
    try:
        held.count()
        return checkpoint(held.select("*"))
    finally:
        held.unpersist()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors, once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_jobpanel_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="jobpanel-zip-"), "jobpanel.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("jobpanel", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._jobpanel_shipped = True


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hands Python at most `rows` rows at a time: ten thousand texts or token lists can be hundreds of megabytes."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if now <= 0 or now > rows:
        spark.conf.set(setting, str(rows))


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Give a scan of few splits `per_core` partitions per core; larger scans stay as they are.

    For plain scans ahead of per-row text work only: it asks for the number of
    splits, which costs no job.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
