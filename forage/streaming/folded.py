"""A keyed log of stream batches, folded into versioned base snapshots.

``<path>/log/batch_id=N`` holds the rows of a batch and is replaced whole when
the batch is replayed.  ``fold`` merges finished batches and the last base into
a new base in a folder of its own, and then adds one row to the manifest, which
is the commit: readers take the newest manifest row once and read only files
that never change, so they see the state before a fold or after it.  A fold
that fails leaves a folder that no row names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forage.operators.state import latest
from forage.session import folders, remove

_MANIFEST = "version long, base string, upto long"


@dataclass(frozen=True)
class Head:
    """A committed version: its base folder, and the last batch in it."""

    version: int = 0
    base: str | None = None
    upto: int = -1


def log_path(path: str, batch_id: int) -> str:
    return f"{path}/log/batch_id={batch_id}"


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(log_path(path, batch_id))


def versions(spark: SparkSession, path: str) -> list[Head]:
    """Committed versions, newest first."""
    if "manifest" not in folders(spark, path):
        return []
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version"), F.desc("base")).collect()
    return [Head(*r) for r in rows]


def finished(spark: SparkSession, path: str) -> list[int]:
    """Batches whose rows are complete."""
    named = (int(n.removeprefix("batch_id=")) for n in folders(spark, f"{path}/log") if n.startswith("batch_id="))
    return sorted(n for n in named if "_SUCCESS" in folders(spark, log_path(path, n)))


def _rows(spark: SparkSession, path: str, head: Head, batches: list[int]) -> DataFrame | None:
    """Base rows and log rows, with their batch_id."""
    parts = [spark.read.parquet(f"{path}/base/{head.base}")] if head.base else []
    if batches:
        parts.append(spark.read.option("basePath", f"{path}/log").parquet(*(log_path(path, n) for n in batches)).withColumn("batch_id", F.col("batch_id").cast("long")))
    return parts[0].unionByName(parts[1], allowMissingColumns=True) if len(parts) == 2 else parts[0] if parts else None


def current(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame | None:
    """The last row of every key over the base and the batches after it, with ``batch_id``; None before the first batch.

    Later batches win, inside a batch the later row by ``order``.
    """
    head = next(iter(versions(spark, path)), Head())
    rows = _rows(spark, path, head, [n for n in finished(spark, path) if n > head.upto])
    return None if rows is None else latest(rows, keys, ["batch_id", *order])


def fold(spark: SparkSession, path: str, keys: list[str], order: list[str], stopped: bool = False) -> Head:
    """Merge finished batches into a new base; returns the newest version.

    The newest batch may still be replayed and stays out, unless the stream has ``stopped``.
    """
    head = next(iter(versions(spark, path)), Head())
    done = finished(spark, path)
    batches = [n for n in (done if stopped else done[:-1]) if n > head.upto]
    if not batches:
        return head
    merged = latest(_rows(spark, path, head, batches), keys, ["batch_id", *order])
    folded = Head(head.version + 1, f"version={head.version + 1}-{uuid.uuid4().hex}", batches[-1])
    merged.write.parquet(f"{path}/base/{folded.base}")
    row = spark.createDataFrame([(folded.version, folded.base, folded.upto)], _MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return folded


def retire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete what only versions older than the newest ``keep`` read: their bases, and batches folded into all kept ones."""
    kept = versions(spark, path)[:keep]
    if not kept:
        return
    for name in folders(spark, f"{path}/base"):
        number = int(name.removeprefix("version=").split("-")[0])
        if number < kept[-1].version:
            remove(spark, f"{path}/base/{name}")
    for n in finished(spark, path):
        if n <= kept[-1].upto:
            remove(spark, log_path(path, n))
