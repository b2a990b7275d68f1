"""Current state of keyed tables from their change logs.

Every step is a grouped aggregate with map-side combining, so a key that owns a
large share of the log never lands in one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from forage.session import cut


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by ``order``."""
    return _pick(log, keys, order, F.max_by)


def earliest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by ``order``."""
    return _pick(log, keys, order, F.min_by)


def _pick(log: DataFrame, keys: list[str], order: list[str], choose) -> DataFrame:
    rest = [c for c in log.columns if c not in keys]
    row = choose(F.struct(*rest), F.struct(*order)).alias("row")
    return log.groupBy(*keys).agg(row).select(*keys, "row.*").select(*log.columns)


# --- catalog ----------------------------------------------------------------


def with_key(batch: DataFrame) -> DataFrame:
    """Take ``_id`` where ``restaurant_id`` is missing or empty; the key stays null when both are."""
    key = F.nullif(F.col("restaurant_id"), F.lit(""))
    if "_id" in batch.columns:
        key = F.coalesce(key, F.nullif(F.col("_id"), F.lit("")))
        return batch.withColumn("restaurant_id", key).drop("_id")
    return batch.withColumn("restaurant_id", key)


def _keyed(batch: DataFrame, strict: bool) -> DataFrame:
    keyed = with_key(batch)
    if strict:
        message = F.raise_error(F.lit("document must have a restaurant_id")).cast("string")
        keyed = keyed.withColumn("restaurant_id", F.coalesce("restaurant_id", message))
    return keyed


def replace(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Whole documents of ``fresh`` in the place of those with their key; one row per key in ``fresh``."""
    kept = current.join(fresh.select("restaurant_id"), "restaurant_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert(current: DataFrame, batch: DataFrame, order: list[str], strict: bool = False) -> DataFrame:
    """Replace whole documents by key; the last batch row of a key wins.

    Rows without a key are left out, or raise when ``strict``.
    """
    keyed = _keyed(batch, strict).filter(F.col("restaurant_id").isNotNull())
    fresh = latest(keyed, ["restaurant_id"], order)
    return replace(current, fresh.drop(*[c for c in order if c not in current.columns]))


def upsert_table(current: DataFrame, batch: DataFrame, order: list[str], path: str, strict: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """Write the catalog after an upsert; returns it and the rows ``indexed`` and ``rejected``.

    The batch is read once: its rows are counted on their way into the table of
    new documents, which both sides of the merge then read.
    """
    seen = Observation()
    keyed = _keyed(batch, strict)
    rest = F.struct(*(c for c in keyed.columns if c != "restaurant_id"))
    grouped = keyed.groupBy("restaurant_id").agg(F.max_by(rest, F.struct(*order)).alias("_row"), F.count(F.lit(1)).alias("_rows"))
    # counted after the shuffle, where the rows of a lost task are not counted again
    has_key = F.col("restaurant_id").isNotNull()
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("_rows"))), F.lit(0))
    counted = grouped.observe(seen, total(has_key).alias("indexed"), total(~has_key).alias("rejected"))
    fresh = cut(counted.filter(has_key).select("restaurant_id", "_row.*").select(*keyed.columns), "fresh-documents")
    merged = replace(current, fresh.drop(*[c for c in order if c not in current.columns]))
    return rebuild(merged, path), {"indexed": 0, "rejected": 0, **seen.get}


def upsert_counts(batch: DataFrame) -> DataFrame:
    """Accepted and rejected rows of a batch."""
    has_key = F.col("restaurant_id").isNotNull()
    return with_key(batch).agg(F.count_if(has_key).alias("indexed"), F.count_if(~has_key).alias("rejected"))


def rebuild(catalog: DataFrame, path: str) -> DataFrame:
    """Write a new snapshot and read it back; readers of older snapshots are not disturbed."""
    catalog.write.mode("overwrite").parquet(path)
    return catalog.sparkSession.read.schema(catalog.schema).parquet(path)


# --- saved restaurants ------------------------------------------------------


def saved_state(log: DataFrame, order: list[str]) -> DataFrame:
    """(user, restaurant, saved_at) of everything still saved.

    Saving twice keeps the first time; unsaving forgets it, so the time is that
    of the first save after the last unsave.
    """
    keys = ["user_id", "restaurant_id"]
    at = F.struct(*order)
    last_unsave = log.groupBy(*keys).agg(F.max(F.when(F.col("op") == "unsave", at)).alias("cut"))
    saves = log.filter(F.col("op") == "save").join(last_unsave, keys, "left")
    live = saves.filter(F.col("cut").isNull() | (at > F.col("cut")))
    return live.groupBy(*keys).agg(F.min("ts").alias("saved_at"))


def saved_list(state: DataFrame) -> DataFrame:
    """Newest first within each user; a user's rows lie together."""
    return state.repartition("user_id").sortWithinPartitions("user_id", F.desc("saved_at"), "restaurant_id")


def saved_flag(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Mark each (user, restaurant) pair that the user has saved."""
    keys = ["user_id", "restaurant_id"]
    return pairs.join(state.select(*keys, F.lit(True).alias("hit")), keys, "left").select(
        *pairs.columns, F.col("hit").isNotNull().alias("is_saved")
    )


# --- diary and foods --------------------------------------------------------


def apply_deletes(entries: DataFrame, deletes: DataFrame) -> DataFrame:
    """Drop entries whose delete names both the entry and its owner."""
    return entries.join(deletes.select("id", "user_id").distinct(), ["id", "user_id"], "left_anti")


def numbered(df: DataFrame, order: list[str], start: Column, name: str) -> DataFrame:
    """Gap-free numbers after ``start`` in sort order.

    A distributed sort gives every row its partition and place; only the
    per-partition counts go through one running sum.  The sorted rows are
    written down so that counts and places always come from the same sort.
    """
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = placed.withColumn("_part", part).withColumn("_place", place).join(F.broadcast(offsets), "_part")
    return rows.withColumn(name, (start + F.col("_before") + F.col("_place") + 1).cast("bigint")).drop(
        "_at", "_part", "_place", "_before"
    )


def confirm_estimates(foods: DataFrame, confirmed: DataFrame, at: str, tie: str) -> DataFrame:
    """Append confirmed estimates as verified foods with the next ids in confirmation order."""
    last = foods.agg(F.coalesce(F.max("food_id"), F.lit(0)).alias("id")).scalar()
    fresh = numbered(confirmed, [at, tie], last, "food_id").withColumn("verified", F.lit(True))
    return foods.unionByName(fresh.drop(at, tie), allowMissingColumns=True)


def append_feedback(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Append-only; users and optional columns may be missing."""
    return current.unionByName(batch, allowMissingColumns=True)


# --- estimate cache ---------------------------------------------------------


def fresh_estimates(responses: DataFrame, asof: Column, ttl_days: int, key: str = "cache_key") -> DataFrame:
    """Newest usable response per key that is not older than the time to live."""
    live = responses.filter((F.col("ts") <= asof) & (F.col("ts") > asof - F.make_dt_interval(F.lit(ttl_days))))
    return latest(live, [key], ["ts", "event_id"])
