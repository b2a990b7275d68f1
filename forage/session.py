"""Shared folder for checkpoints, stream state and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, else the one that the session checkpoints to.

    A session whose tasks all run on this machine may name none and gets a
    folder of its own; on a cluster that is an error, because executors would
    not see each other's files.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """Write rows to a table in the shared folder and read them back.

    Later steps start from the files: lost executors cost no recomputation, and
    rows keep the values they were written with.
    """
    return cut_at(df, work_path(df.sparkSession, purpose))


def cut_at(df: DataFrame, path: str) -> DataFrame:
    """``cut`` to a path that the caller removes when the rows are not read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query shuffled is deleted when the query ends; steps that ``cut`` writes down do not need it again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Python tasks are given so many rows at once, for rows that are long."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def dealt(table: DataFrame) -> DataFrame:
    """A table of files for work that is heavy per row.

    Files that split into fewer parts than there are cores, such as one row
    group, are dealt out once; larger ones are left as they are read.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Let streams of this session keep list, map and timer state, unless it names a store of its own."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(STATE_STORE):
        spark.conf.set(STATE_STORE, _ROCKSDB)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no such folder."""
    files, folder = _folder(spark, path)
    return sorted(status.getPath().getName() for status in files.listStatus(folder)) if files.exists(folder) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote."""
    files, folder = _folder(spark, path)
    files.delete(folder, True)
