"""Top rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to so many rows per key Spark cuts each map task to its own best rows before
# the shuffle, so a hot key costs k rows per task.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int, spread_by: str, rank: str = "position", salts: int = 64
) -> DataFrame:
    """The first ``k`` rows of every key with their 1-based rank.

    Beyond the session's group-limit threshold the cut is made in two steps: first inside
    ``salts`` slices of every key (slices by hash of ``spread_by``), then over
    the survivors, so no task ever sorts a whole hot key.
    """
    if k > int(df.sparkSession.conf.get(GROUP_LIMIT)):
        slice_of = F.pmod(F.xxhash64(spread_by), F.lit(salts))
        inner = Window.partitionBy(*keys, slice_of).orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(inner)).filter(F.col(rank) <= k).drop(rank)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= k)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: str, deepest: int, spread_by: str, rank: str = "position") -> DataFrame:
    """The first rows of every key with their 1-based rank; column ``k`` says how many of its key.

    ``deepest`` is the largest ``k``.  Keys that ask for no more than the
    session's group-limit threshold are cut in each map task first; only the
    others, which may ask for any number, take the salted cut, where each slice
    of a key keeps as many rows as the key asks for.
    """
    limit = int(df.sparkSession.conf.get(GROUP_LIMIT))
    shallow = top_k(df.filter(F.col(k) <= limit), keys, order, min(deepest, limit), spread_by, rank).filter(F.col(rank) <= F.col(k))
    if deepest <= limit:
        return shallow
    slice_of = F.pmod(F.xxhash64(spread_by), F.lit(64))
    inner = Window.partitionBy(*keys, slice_of).orderBy(*order)
    deep = df.filter(F.col(k) > limit).withColumn(rank, F.row_number().over(inner)).filter(F.col(rank) <= F.col(k)).drop(rank)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return shallow.unionByName(deep.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= F.col(k)))
