"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, function, **added: T.DataType) -> DataFrame:
    """Run ``function`` over Arrow batches of ``df``; it returns the batch's columns and the added ones.

    A column of ``df`` that has the name of an added one is replaced.
    """
    df = df.drop(*added)
    return df.mapInArrow(function, T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added.items())]))


def chance(*key: str) -> Column:
    """A number in 0 to 1 that a row's key always gets."""
    return (F.shiftrightunsigned(F.xxhash64(*key, F.lit("chance")), 11)) / float(2**53)


def sampled(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """About ``rows`` rows, those whose key's number is low enough; all rows where there are fewer.

    The share is known before the rows are read, so no task has to send more
    than it contributes.  The size stays below twice ``rows`` unless keys repeat.
    """
    total = df.count()
    return df if total <= rows else df.filter(chance(*key) < rows / total).limit(2 * rows)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """Rename columns that have one of ``names``, in any case; returns the new names of all columns by their old ones."""
    taken = {n.lower() for n in names}
    renamed = {c: f"_kept_{k}_{c}" if c.lower() in taken else c for k, c in enumerate(df.columns)}
    return df.withColumnsRenamed({c: n for c, n in renamed.items() if c != n}), renamed


#: Cells of the table that says which rows may be wanted; its size is fixed, however many are.
CELLS = 1 << 20


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and text of the wanted documents.

    Most other texts are left out where they are read, by a table of hashed
    ids; the join decides.
    """
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int")
    wanted = wanted.select("doc_id").distinct()
    maybe = np.zeros(CELLS, dtype=bool)
    maybe[wanted.select(cell.alias("cell")).distinct().toPandas()["cell"].to_numpy(dtype=np.int64)] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(maybe))

    def run(batches):
        known = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(known[batch.column("_cell").to_numpy()])).select(["doc_id", "text"])

    rows = docs.select("doc_id", "text", cell.alias("_cell"))
    return rows.mapInArrow(run, T.StructType(rows.schema.fields[:2])).join(wanted, "doc_id")
