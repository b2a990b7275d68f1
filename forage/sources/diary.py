"""Diary table by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forage import schemas


def append_food_log(entries: DataFrame, path: str) -> None:
    """Append entries to a table with one folder per day.

    Rebalancing by day keeps the number of files small and still splits a day
    that holds a large share of the rows.
    """
    entries.hint("rebalance", "log_date").write.mode("append").partitionBy("log_date").parquet(path)


def read_food_log(spark: SparkSession, path: str) -> DataFrame:
    """The diary in its declared layout; filters on ``log_date`` open only the folders of those days."""
    return spark.read.schema(schemas.FOOD_LOG).parquet(path)
