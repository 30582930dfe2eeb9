"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark's own setting: the shuffle files of a job go when it ends, not when the driver's collector finds them unused
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "chronotext", cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster, pass in the session you already have."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a session that runs on this machine alone may leave it
    unset; it then gets a local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a running session that was started without it (see --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="package-"), "chronotext"), "zip", root,
                                  "chronotext")
    spark.sparkContext.addPyFile(archive)


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside leave no shuffle files: for jobs whose result is stored or counted, so that none reads them again."""
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write to the shared folder and read back: lost executors re-read a file instead of replaying the job.

    A parquet table rather than an RDD checkpoint, so that later steps read only the columns they need and Spark
    knows the size when it picks a join. The job's shuffle files go at once: a written table needs them no more.
    """
    path = new_dir(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop_tables(*tables: DataFrame | None) -> None:
    """Delete tables of ``cut_lineage`` (others are passed over) that no later step reads."""
    for t in tables:
        path = t.__dict__.get("stored_path") if t is not None else None
        if path:
            spark = t.sparkSession
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int) -> None:
    """Let Python see at most so many rows at a time, where rows are wide: a session setting, which is lowered only."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if now <= 0 or now > rows:
        spark.conf.set(setting, rows)


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over the cores before work that is heavy per row.

    Goes by Spark's size estimate and runs nothing. An input large enough to have a split per core is left alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df
