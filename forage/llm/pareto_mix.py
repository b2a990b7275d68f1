"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

1. Sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1 ...; together
   they share the words of all documents.  A source's target stops at
   ``MOST`` times its words, and what is above is shared anew by weight.
2. Inside a source a document counts in proportion to the binary length of its
   word count, so long documents are gently favoured: its expected copies are
   that weight times one factor of the source, at most ``MOST``.
3. The whole part of the expected copies is certain.  The fraction is an
   inclusion probability: documents are ranked by random odds over inclusion
   odds, and taken in that order until the source's words are used up, which
   makes the sample's size fixed.

Every sum is aggregated before anything is ordered.  Ranks in a source of any
size are found by refining: words per bin of the rank variable show which bins
are taken whole; only the one bin at the edge is looked at more closely, and
only the few documents of its edge bin are sorted.  Sorted as a whole are the
distinct sources, at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forage.session import cut

MOST = 3
WEIGHTS = [5, 2, 1]
WORD = r"[^\x20\x09-\x0D]+"
#: Bins of the rank variable at each of the two refinements.
BINS = 4096


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _level(share: Column, weight: Column, most: Column, key: list, order: list) -> Column:
    """The factor per unit of weight at which shares, each cut at ``most``, add up to ``share``; order: most over weight, ascending."""
    whole = Window.partitionBy(*key)
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(most).over(before), F.lit(0))
    left = F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0))
    return (share - used) / left


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size and target of every source.

    This ranks the distinct sources in one task; documents are summed before.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("most", MOST * F.col("source_size"))
    total = F.sum("source_size").over(Window.partitionBy())
    level = _level(total, F.col("weight"), F.col("most"), [], [F.col("most") / F.col("weight"), F.col("rank")])
    ranked = ranked.withColumn("level", level)
    target = F.least(F.col("most").cast("double"), F.max("level").over(Window.partitionBy()) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def copies(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source and length class: certain copies, inclusion probability of one more, and the words left for the source's sample."""
    classes = sized.filter("size > 0").groupBy("source", "class").agg(F.sum("size").alias("words"))
    classes = _by_source(classes, sources).withColumn("mass", F.col("class") * F.col("words"))
    level = _level(F.col("target"), F.col("mass"), MOST * F.col("words"), ["source"], [F.col("class").desc()])
    classes = classes.withColumn("level", level)
    best = F.max("level").over(Window.partitionBy("source"))
    expected = F.when(F.col("target") >= MOST * F.col("source_size"), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), best * F.col("class")))
    expected = F.floor(expected * 1e9 + 0.5) / 1e9
    classes = classes.withColumn("expected", expected).withColumn("certain", F.floor("expected"))
    left = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("source"))
    return classes.select("source", "class", "certain", (F.col("expected") - F.col("certain")).alias("odds"), left.alias("left"))


def _by_source(df: DataFrame, other: DataFrame, *more: str) -> DataFrame:
    """Left join on source, where null equals null."""
    other = other.withColumnsRenamed({c: f"_{c}" for c in ["source", *more]})
    match = df["source"].eqNullSafe(other["_source"])
    for c in more:
        match = match & (df[c] == other[f"_{c}"])
    return df.join(other, match, "left").drop("_source", *[f"_{c}" for c in more])


def _edge(ranked: DataFrame, bin_name: str, left: str) -> DataFrame:
    """Per source: the first bin that is not taken whole, and the words left for it."""
    bins = ranked.groupBy("source", bin_name).agg(F.sum("size").alias("words"), F.first(left).alias("left"))
    end = F.sum("words").over(Window.partitionBy("source").orderBy(bin_name).rowsBetween(Window.unboundedPreceding, 0))
    open_bins = bins.withColumn("end", end).filter("end > left")
    first = F.min_by(F.struct(bin_name, (F.col("left") - F.col("end") + F.col("words")).alias("rest")), bin_name)
    return open_bins.groupBy("source").agg(first.alias("edge")).select("source", F.col(f"edge.{bin_name}").alias(f"edge_{bin_name}"), F.col("edge.rest").alias(f"rest_{bin_name}"))


def mix(docs: DataFrame) -> DataFrame:
    """Add size, source_size, target and taken (words the mix takes) to every document.

    Null and empty texts have no words and none are taken.  A source without
    words has target 0.  Rows that agree in doc_id, source and size are
    interchangeable.  Columns of ``docs`` with the added names are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "copies")
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 13), 16, 10).cast("bigint")
    keep = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    rest = [F.struct("text", *[F.col(f"`{c}`") for c in keep]).alias("_rest")] if keep else []
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), ((number + 0.5) / float(2**52)).alias("u"), *rest)
    sized = cut(sized.withColumn("class", F.length(F.bin("size"))), "sized")
    narrow = sized.select("doc_id", "source", "size", "class", "u")
    sources = cut(targets(narrow), "targets")
    plan = cut(copies(narrow, sources), "copies")

    odds, u = F.col("odds"), F.col("u")
    rank = (u / (1 - u)) / (odds / (1 - odds))
    spot = F.col("rank") / (1 + F.col("rank"))

    def ranked(rows: DataFrame) -> DataFrame:
        rows = _by_source(rows, plan, "class").withColumn("rank", F.when(odds > 0, rank))
        return rows.withColumn("bin", F.floor(spot * BINS)).withColumn("fine", F.floor(spot * BINS * BINS) % BINS)

    sampled = ranked(narrow).filter("rank is not null")
    coarse = _edge(sampled, "bin", "left")
    near = _by_source(sampled, coarse).filter("bin = edge_bin")
    fine = _edge(near, "fine", "rest_bin")
    edges = cut(_by_source(coarse, fine), "edges")

    rows = _by_source(_by_source(ranked(sized), sources), edges)
    at_edge = F.col("rank").isNotNull() & (F.col("bin") == F.col("edge_bin")) & (F.col("fine") == F.col("edge_fine"))
    whole = F.col("rank").isNotNull() & (F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & (F.col("edge_fine").isNull() | (F.col("fine") < F.col("edge_fine")))))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge_rows = rows.filter(F.coalesce(at_edge, F.lit(False))).withColumn("chosen", before + F.col("size") / 2 <= F.col("rest_fine"))
    other_rows = rows.filter(~F.coalesce(at_edge, F.lit(False))).withColumn("chosen", F.coalesce(whole, F.lit(False)))
    every = other_rows.unionByName(edge_rows).withColumn("copies", F.coalesce(F.col("certain"), F.lit(0)) + F.col("chosen").cast("bigint"))
    columns = [F.col("_rest")[c].alias(c) if c == "text" or c in keep else F.col(f"`{c}`") for c in docs.columns if keep or c != "text"]
    return every.select(*columns, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("int").alias("copies"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
