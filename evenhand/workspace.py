"""Session builder and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(app: str = "evenhand", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC; cluster settings win when `master` is None."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="evenhand-")
    return _LOCAL_FOLDERS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "settled", schema: T.StructType | None = None) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    Used where a result feeds several jobs: the scan behind it runs once, a lost executor costs
    no recomputation, and later plans see true sizes. A table that is settled already is returned
    as it is. `schema` re-reads the same columns under another type of equal layout (see
    `models.encoding.as_vectors`).
    """
    if getattr(df, "_settled", False):
        return df
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(schema if schema is not None else df.schema).parquet(path)
    table._settled = True
    return table


def concurrently(spark: SparkSession, jobs: Sequence[Callable], parallelism: int = 8) -> list:
    """Run independent driver-side calls a few at a time; each one is a distributed Spark job."""
    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs)


def gather(df: DataFrame, rows: int, rows_per_task: int = 20_000) -> DataFrame:
    """Merge tiny partitions of a table that an iterative fit reads again and again.

    Only ever lowers the number of partitions, and only below one task per `rows_per_task` rows.
    """
    return df.coalesce(max(1, rows // rows_per_task))


def portion(df: DataFrame, rows: int, rows_per_task: int = 250_000) -> DataFrame:
    """Deal rows anew if tasks would hold more than `rows_per_task` of them, so that a task does not grow with the table."""
    tasks = -(-rows // rows_per_task)
    return df.repartition(tasks) if tasks > 1 and df.rdd.getNumPartitions() < tasks else df


def dealt(df: DataFrame, key: str, rows: int, rows_per_task: int = 50_000) -> DataFrame:
    """Deal rows to tasks by `key`: what becomes of them can then be grouped by it without another shuffle.

    Meant for packed rows before they are unpacked. Tasks hold about `rows_per_task` rows, however many there are.
    All rows of one key, or of a null key, share a task.
    """
    tasks = -(-rows // rows_per_task)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), key)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows if they come from fewer files than there are cores.

    Files of one row group are read by one task each. Sources with enough files are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
