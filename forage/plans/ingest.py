"""Crawl dump -> normalised, labelled, merged catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame

from forage.operators.state import upsert
from forage.sources.catalog import label_catalog


def ingest(current: DataFrame, normalized: DataFrame, order: list[str]) -> DataFrame:
    """Label fetched restaurants and merge them into the catalog.

    An empty fetch leaves the catalog as it is: the merge of nothing is the
    catalog itself, so no separate check is needed.
    """
    return upsert(current, label_catalog(normalized), order)
