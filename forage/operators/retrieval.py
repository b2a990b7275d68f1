"""BM25 retrieval as joins: query terms against catalog terms.

One table of *needs* (distinct retrieval requests) is answered against one
catalog.  The catalog text is cut to terms once: every field of a document adds
a mark to its terms, the asked terms and the marks are counted inside the scan
stage, and the narrow table that leaves it holds a row per document, field and
asked term.  The rows of the mark carry the field lengths, so statistics,
document frequencies and scores all come from this one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forage.functions import fixed
from forage.functions.text import analyze

FIELDS = list(fixed.FIELD_BOOSTS)
SCORE_DIGITS = 6


#: Stands in every field that has text; no term is empty.
MARK = ""
POSTING = ["restaurant_id", "field", "dl", "term"]
#: Postings that one task adds up; its table of scores has no more rows.
SCORED_ROWS = 1 << 19


def _terms(catalog: DataFrame, fields: list[str], words) -> DataFrame:
    """One row per term of ``words`` and one for the mark, of every field with text: id, field, its length, term.

    The outer form of the first explode keeps the optimizer from testing the
    term lists for emptiness below it, which would cut all text twice.
    """
    each = F.transform(F.array(*fields), lambda text: F.transform(F.array(analyze(text)), lambda w: F.struct(F.size(w).alias("dl"), words(w).alias("words")))[0])
    return (
        catalog.select("restaurant_id", F.posexplode_outer(each).alias("field", "_in"))
        .filter(F.col("_in.dl") > 0)
        .select("restaurant_id", "field", F.col("_in.dl").alias("dl"), F.explode(F.array_append("_in.words", F.lit(MARK))).alias("term"))
    )


def postings(catalog: DataFrame, vocabulary: DataFrame | None = None, fields: list[str] = FIELDS) -> DataFrame:
    """(restaurant_id, field, dl, term, tf) of every term and of the mark.

    With a vocabulary, terms nobody asks for are dropped first.  A document is
    one row of the scan, so counting before the shuffle takes in all of its
    occurrences, and each term of it is sent once.
    """
    found = _terms(catalog, fields, lambda w: w)
    if vocabulary is not None:
        found = found.join(asked(vocabulary), "term", "left_semi")
    return found.groupBy(*POSTING).agg(F.count(F.lit(1)).alias("tf"))


def asked(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary and the mark."""
    return vocabulary.select("term").unionByName(vocabulary.sparkSession.createDataFrame([(MARK,)], "term string"))


def corpus_stats(posting_rows: DataFrame) -> DataFrame:
    """(field, n, avgdl): documents with text in the field, and their mean length, from the rows of the mark."""
    return posting_rows.filter(F.col("term") == MARK).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def corpus_frequency(catalog: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(field, term, df, total) of the whole corpus; ``total`` adds up the lengths of the documents that have the term.

    Each document's distinct terms are found inside its own row, so only counts
    are shuffled, never document rows.  The mark's row has the field's size and
    length.
    """
    distinct = _terms(catalog, fields, F.array_distinct)
    return distinct.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total"))


def document_frequency(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.filter(F.col("term") != MARK).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: str, df: str) -> str:
    """Inverse document frequency as SQL over column names."""
    return f"ln(1 + ({n} - {df} + 0.5D) / ({df} + 0.5D))"


def saturation(tf: str, dl: str, avgdl: str) -> str:
    """Length-normalised term frequency as SQL over column names."""
    k1, b = fixed.BM25_K1, fixed.BM25_B
    return f"{tf} / ({tf} + {k1}D * ({1 - b}D + {b}D * {dl} / {avgdl}))"


def need_terms(needs: DataFrame) -> DataFrame:
    """(need, term, mult, group, need_terms): a repeated term keeps its multiplicity.

    ``terms`` is an array of structs (group, term): the group numbers the query
    word that a synonym set stands for.
    """
    return (
        needs.select("need", F.size("terms").alias("n_terms"), "n_groups", F.inline("terms"))
        .groupBy("need", "n_terms", "n_groups", "term")
        .agg(F.count("*").alias("mult"), F.collect_set("group").alias("groups"))
    )


def required_matches(n: Column, percent: int = fixed.MIN_MATCH_PERCENT) -> Column:
    return F.greatest(F.lit(1), F.floor(n * percent / 100)).cast("bigint")


def matching_postings(terms: DataFrame, catalog: DataFrame, posting_rows: DataFrame | None = None, fields: list[str] = FIELDS) -> DataFrame:
    """Postings of the asked terms and the mark, cut from the catalog or taken from a table of all postings."""
    vocabulary = terms.select("term").distinct()
    if posting_rows is None:
        return postings(catalog, vocabulary, fields)
    return posting_rows.join(asked(vocabulary), "term", "left_semi").select(*POSTING, "tf")


def score_tasks(terms: DataFrame, found: DataFrame) -> int | None:
    """Tasks that add up the scores: as many as the matches ask for, which are counted, and no fewer than there are cores; none where one task may hold them all.

    Packed by shuffled bytes, which are few for the rows they hold, a task would get more scores the more there are.
    """
    matches = document_frequency(found).join(terms.groupBy("term").agg(F.count(F.lit(1)).alias("needs")), "term")
    rows = matches.agg(F.coalesce(F.sum(F.col("df") * F.col("needs")), F.lit(0))).first()[0]
    return max(found.sparkSession.sparkContext.defaultParallelism, -(-rows // SCORED_ROWS)) if rows > SCORED_ROWS else None


def field_scores(terms: DataFrame, found: DataFrame, expansion: str = "flat", fields: dict[str, float] = fixed.FIELD_BOOSTS) -> DataFrame:
    """Per (need, document) the boosted score and match count of every field.

    Adaptive execution broadcasts the term side where its size at run time
    allows, and otherwise shuffles by term and splits hot terms.
    """
    weighted = (
        terms.join(document_frequency(found), "term")
        .join(corpus_stats(found), "field")
        .select("need", "n_terms", "n_groups", "term", "field", "groups", "mult", "avgdl", F.expr(f"mult * {idf('n', 'df')} AS w"))
    )
    matched = found.join(weighted, ["field", "term"]).withColumn("part", F.expr(f"w * {saturation('tf', 'dl', 'avgdl')}"))
    aggregates = ["max(n_terms) AS n_terms", "max(n_groups) AS n_groups"]
    for i, boost in enumerate(fields.values()):
        aggregates.append(f"{boost}D * sum(CASE WHEN field = {i} THEN part END) AS score_{i}")
        if expansion == "grouped":
            count = f"CAST(size(array_distinct(flatten(collect_set(CASE WHEN field = {i} THEN groups END)))) AS BIGINT)"
        else:
            count = f"coalesce(sum(CASE WHEN field = {i} THEN mult END), 0)"
        aggregates.append(f"{count} AS matched_{i}")
    # a document's rows lie in as many tasks as it has terms, so counting before the shuffle would hold nearly all of them and merge few
    tasks = score_tasks(terms, found)
    return matched.repartition(*([tasks] if tasks else []), "need", "restaurant_id").groupBy("need", "restaurant_id").agg(*map(F.expr, aggregates))


def best_field(scores: DataFrame, n_fields: int, expansion: str = "flat", percent: int = fixed.MIN_MATCH_PERCENT) -> DataFrame:
    """Documents where at least one field matches enough terms; the best such field gives the score."""
    needed = required_matches(F.col("n_groups" if expansion == "grouped" else "n_terms"), percent)
    passing = [F.when(F.col(f"matched_{i}") >= needed, F.col(f"score_{i}")) for i in range(n_fields)]
    best = F.greatest(*passing) if n_fields > 1 else passing[0]
    return scores.select("need", "restaurant_id", F.round(best, SCORE_DIGITS).alias("text_score")).filter(
        F.col("text_score").isNotNull()
    )
