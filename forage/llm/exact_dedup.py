"""Exact duplicates by content hash, with DataFrame functions only.

Texts are equal when the same characters remain after all of ``BLANK`` is taken
out; null counts as empty.

1. Every row gets the 128-bit hash of its remaining text; hash, length and id
   are written as a narrow table, and all counting works on that.
2. Hashes that several rows have are marked in a bit table of bounded size, so
   that rows without a partner pass by every later join.
3. Rows that share a hash are compared byte by byte: they are grouped by hash
   and text, and equal texts meet inside each map task first, so a text with a
   million copies leaves each task once.  A hash that keeps more than one text
   is a collision, and its rows are grouped by the text itself.
4. Of equal texts the longest original stays, then the smallest ``doc_id``
   (null last), then the first row read.

A null or repeated ``doc_id`` is a row like any other.  An empty table gives an
empty one.  Columns of other names are not looked at; ``keep_first`` returns
them as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forage.llm.frames import set_aside
from forage.session import cut

BLANK = " \t\n\v\f\r"
#: Bits per shared hash, and the most bits of the table: 262,144 rows of two numbers.
#: A fuller table lets more rows without a partner into the joins and changes no result.
BITS_EACH, MOST_BITS = 64, 1 << 24


def md5_bytes(text: Column) -> Column:
    """The 128-bit hash of a text."""
    return F.unhex(F.md5(text))


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANK, "")


@dataclass
class Marks:
    """Hashes of ``keys`` as a broadcast bit table: rows it does not mark have none of them."""

    bits: int
    table: DataFrame

    @staticmethod
    def of(keys: DataFrame) -> Marks:
        bits = min(MOST_BITS, max(1 << 12, 1 << (BITS_EACH * keys.count()).bit_length()))
        table = keys.select(*Marks._place(bits)).groupBy("_word").agg(F.bit_or("_bit").alias("_set"))
        return Marks(bits, table)

    @staticmethod
    def _place(bits: int) -> list[Column]:
        cell = F.pmod(F.xxhash64("_hash"), F.lit(bits))
        return [F.shiftright(cell, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(_hash), {bits}) % 64 as int))").alias("_bit")]

    def flag(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_maybe``: false only where the row's hash is none of the marked ones."""
        placed = df.select("*", *self._place(self.bits)).join(F.broadcast(self.table), "_word", "left")
        return placed.withColumn("_maybe", F.coalesce(F.col("_set").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).drop("_word", "_bit", "_set")


@dataclass
class Groups:
    """What the passes over the texts leave."""

    #: doc_id, _hash, _exact, _chars, text_sha256, _row, _maybe of every row.
    rows: DataFrame
    #: _hash, _exact, keep_id, _keep_chars, _keep_row, group_size of the marked rows' groups.
    keepers: DataFrame
    marks: Marks
    #: Hashes that several texts have, or None.
    collided: DataFrame | None


def _hashed(docs: DataFrame, content_hash: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("*", content_hash(normalised(F.col("text"))).alias("_hash"), F.char_length(text).cast("bigint").alias("_chars"))


def _exact(collided: bool) -> Column:
    """What tells texts of one hash apart: nothing, unless the hash collided."""
    return F.concat(F.lit("="), normalised(F.col("text"))) if collided else F.lit("")


def find(docs: DataFrame, content_hash: Callable[[Column], Column] = md5_bytes) -> Groups:
    """Group the rows of ``docs`` (doc_id, text) by equal text."""
    texts = docs.select("doc_id", "text")
    digest = F.sha2(normalised(F.col("text")), 256).alias("text_sha256")
    row = F.monotonically_increasing_id().alias("_row")
    names = ["doc_id", "_hash", "_chars", "text_sha256", "_row"]
    narrow = cut(_hashed(texts, content_hash).select("*", digest, row).select(*names), "hashed")
    shared = cut(narrow.groupBy("_hash").count().filter("count > 1").select("_hash"), "shared-hashes")
    marks = Marks.of(shared)
    alike = marks.flag(_hashed(texts, content_hash)).filter("_maybe").select("_hash", normalised(F.col("text")).alias("_normal"))
    collided = cut(alike.distinct().groupBy("_hash").count().filter("count > 1").select("_hash"), "collisions")
    rows = marks.flag(narrow).withColumn("_exact", _exact(False))
    if collided.isEmpty():
        collided = None
    else:
        odd = _hashed(texts, content_hash).join(collided, "_hash").select(*texts.columns, "_hash", "_chars", digest, row)
        odd = cut(odd.select(*names, _exact(True).alias("_exact")), "collided")
        rows = rows.join(collided, "_hash", "left_anti").unionByName(odd.withColumn("_maybe", F.lit(True)))
    best = F.min(F.struct((-F.col("_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("_row").alias("first"))).alias("best")
    keepers = rows.filter("_maybe").groupBy("_hash", "_exact").agg(F.count(F.lit(1)).alias("group_size"), best)
    keepers = keepers.select(
        "_hash", "_exact", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("_keep_chars"), F.col("best.first").alias("_keep_row")
    )
    return Groups(rows, keepers, marks, collided)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    groups = find(docs)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = groups.rows.filter(~F.col("_maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    shared = groups.rows.filter("_maybe").join(groups.keepers, ["_hash", "_exact"]).withColumn("kept", F.col("_row") == F.col("_keep_row"))
    return alone.unionByName(shared.select(*columns))


def keep_first(docs: DataFrame, content_hash: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns.

    Of rows that agree in text, length and ``doc_id``, any one stays.
    """
    docs, renamed = set_aside(docs, "_hash", "_exact", "_chars", "_maybe", "_word", "_bit", "_set", "_keep_chars", "_keep_row", "keep_id", "group_size")
    groups = find(docs, content_hash)
    marked = groups.marks.flag(_hashed(docs, content_hash))
    alone = marked.filter(~F.col("_maybe")).select(*docs.columns)
    shared = marked.filter("_maybe")
    if groups.collided is None:
        shared = shared.withColumn("_exact", _exact(False))
    else:
        odd = groups.collided.select("_hash", F.lit(True).alias("_odd"))
        shared = shared.join(odd, "_hash", "left").withColumn("_exact", F.when(F.col("_odd"), _exact(True)).otherwise(_exact(False)))
    kept = shared.join(groups.keepers, ["_hash", "_exact"]).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_chars") == F.col("_keep_chars")))
    kept = kept.dropDuplicates(["_hash", "_exact"]).select(*docs.columns)
    return alone.unionByName(kept).withColumnsRenamed({n: c for c, n in renamed.items() if c != n})
