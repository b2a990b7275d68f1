"""Micro-batch ingest: places -> normalise -> label -> keyed log -> snapshot.

Places come as raw files, or are fetched for searches that fire and for a
refresh plan.  Every batch writes its documents and their counts under its own
number and whole, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forage.functions import fixed
from forage.operators.state import replace, with_key
from forage.plans.fetch import need_id, needs_of
from forage.sources.catalog import label_catalog
from forage.streaming import folded
from forage.streaming.trigger import stream_triggers

KEY = ["restaurant_id"]
#: Fetches the documents of needs: need_id, position and the restaurant columns.
Fetch = Callable[[DataFrame], DataFrame]


def _log_documents(documents: DataFrame, path: str, batch_id: int) -> None:
    """Label documents and write them with their counts, which are taken while the documents pass by."""
    seen = Observation(f"ingest-{batch_id}")
    has_key = F.col("restaurant_id").isNotNull()
    counted = with_key(documents).observe(seen, F.count_if(has_key).alias("indexed"), F.count_if(~has_key).alias("rejected"))
    folded.write_batch(label_catalog(counted.filter(has_key)), path, batch_id)
    row = documents.sparkSession.createDataFrame([(seen.get["indexed"], seen.get["rejected"])], "indexed long, rejected long")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch_id={batch_id}")


def start_ingest(normalized: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Label arriving restaurants and append them to the log, then stop when the input is used up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _log_documents(batch, path, batch_id)

    return normalized.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_triggered_ingest(
    log: DataFrame, fetch: Fetch, path: str, checkpoint: str, delay: str = "10 minutes", lock_seconds: int = fixed.TRIGGER_LOCK_SECONDS
) -> StreamingQuery:
    """Search log -> triggers -> places found for them -> labelled documents, in one stream.

    The triggers of a batch are written first and read back, so that state is
    asked once and the searches that fired stay on record; different searches
    of a batch are fetched once each.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, asked = batch.sparkSession, f"{path}/triggers/batch_id={batch_id}"
        batch.withColumn("need_id", need_id()).write.mode("overwrite").parquet(asked)
        fired = spark.read.parquet(asked)
        if not fired.isEmpty():
            _log_documents(fetch(needs_of(fired)), path, batch_id)

    fired = stream_triggers(log, delay, lock_seconds)
    return fired.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_refresh_ingest(plan: DataFrame, fetch: Fetch, path: str, checkpoint: str) -> StreamingQuery:
    """Runs of a refresh plan (refresh_key, city, keyword, ts) -> places of the city -> labelled documents.

    A pair that is due several times in one batch is fetched once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, due = batch.sparkSession, f"{path}/runs/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(due)
        runs = spark.read.parquet(due)
        if not runs.isEmpty():
            needs = runs.select(F.col("refresh_key").alias("need_id"), "city", F.col("keyword").alias("q")).distinct()
            _log_documents(fetch(needs), path, batch_id)

    return plan.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, current: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Catalog after all logged batches: later batches win, inside a batch the later row."""
    fresh = folded.current(spark, path, KEY, order)
    return current if fresh is None else replace(current, fresh.drop(*(c for c in ("batch_id", *order) if c not in current.columns)))


def counts(spark: SparkSession, path: str) -> DataFrame:
    """Documents indexed and rejected by each batch."""
    return spark.read.parquet(f"{path}/counts")
